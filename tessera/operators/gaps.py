"""What an answer lacks of what its case asserts.

A case and an answer are JSON.  A case says only what it wants checked: an axis counts where its key is there, whatever
its value; null is a value ("this must stay empty").  So cases are read as variants, which tell an absent key from null,
one string from a list of strings, and a string from a number.  Answers have one schema, which all rules read.

Each rule is a name, the condition under which the case asks for it, and what it finds: a condition, or an array of what is
missing.  ``with_gaps`` compiles all rules into one array expression over answers read once: no joins, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.temporal import month_snap
from tessera.operators.facts import base_confidence, destination, entity_gate

#: Below this confidence a capture, or a relation, goes to review.
REVIEW = 0.7
#: White space that a name may have around it.
BLANK = " \t\n\x0b\f\r"
_MEMORY = "note string, kind string, owner string, event_date string, event_recurring boolean"
_FACT = "struct<predicate: string, value: string, persistence_value: int, evidence_strength: string>"
ANSWER = (
    f"language string, classification_confidence double, cancels_action string, {_MEMORY}, atomic_note string, atomic_note_kind string, atomic_note_owner string, "
    f"memories array<struct<{_MEMORY.replace(' string', ': string').replace(' boolean', ': boolean')}, atomic_note: string, atomic_note_kind: string, atomic_note_owner: string>>, "
    f"entities array<struct<canonical_name: string, aliases: array<string>, type: string, type_proposal: string, renamed_to: string, facts: array<{_FACT}>>>, "
    "relations array<struct<`from`: string, `to`: string, predicate: string, confidence: double>>, project_entries array<string>, "
    "resources array<struct<url: string, entity_canonical: string, user_comment: string>>, obsoleted_facts array<struct<predicate: string, value: string>>"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there, in functions of elements too."""
    return F.get(F.transform(F.array(value), use), 0)


def trimmed(c: Column) -> Column:
    """``c`` without white space around it; most texts have none, and to trim goes over every character."""
    return F.when((c >= "!") & (F.substring(c, -1, 1) >= "!"), c).otherwise(F.btrim(c, F.lit(BLANK)))


def plain(c: Column) -> Column:
    """A name as it is compared: without white space around it, in lower case; null is empty."""
    return F.coalesce(F.lower(trimmed(c)), F.lit(""))


def said(c: Column) -> Column:
    """A text, or null where it is blank or says null or none."""
    return let(c, lambda v: let(trimmed(v), lambda t: F.when((F.length(t) <= 4) & F.lower(t).isin("", "null", "none"), None).otherwise(t)))


def listed(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


class Case:
    """The axes of a case as columns: ``body`` is what ``axes`` makes of it."""

    def __init__(self, body: Column, keys: Column):
        self.body, self.keys = body, F.coalesce(keys, F.array().cast("array<string>"))

    def axis(self, axis: str) -> Column:
        return F.try_element_at(self.body, F.lit(axis))

    def has(self, axis: str) -> Column:
        return F.array_contains(self.keys, axis)

    def kind(self, axis: str) -> Column:
        """The type of the value: STRING, BIGINT, ARRAY<...>, OBJECT<...>, VOID; null if the key is absent."""
        return self.axis(axis)["kind"]

    def text(self, axis: str) -> Column:
        return self.axis(axis)["text"]

    def number(self, axis: str) -> Column:
        return F.try_variant_get(self.axis(axis)["value"], "$", "double")

    def flag(self, axis: str) -> Column:
        return F.try_variant_get(self.axis(axis)["value"], "$", "boolean")

    def asks(self, axis: str) -> Column:
        """Whether the value says anything: not absent, null, false, 0 or empty."""
        return F.coalesce(self.axis(axis)["asks"], F.lit(False))

    def texts(self, axis: str) -> Column:
        """The strings of a value that is one or a list; blank ones and other types are none."""
        each = F.try_variant_get(self.axis(axis)["value"], "$", "array<variant>")
        strings = F.transform(F.filter(each, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
        found = F.coalesce(F.when(self.kind(axis) == "STRING", F.array(self.text(axis))), strings, F.array().cast("array<string>"))
        return F.filter(found, lambda s: plain(s) != "")

    def counts(self, axis: str) -> Column:
        """The numbers of a value that is an object, by key."""
        return F.coalesce(F.try_variant_get(self.axis(axis)["value"], "$", "map<string, double>"), F.create_map().cast("map<string, double>"))


def axes(members: Column) -> Column:
    """value, kind, text (of a string) and asks of each axis, read once, from the members of a case (variants by key)."""

    def read(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        text = F.when(kind == "STRING", F.variant_get(v, "$", "string"))
        asks = ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", "false", "0", "0.0", '""', "[]", "{}")
        return F.struct(v.alias("value"), kind.alias("kind"), text.alias("text"), asks.alias("asks"))

    return F.transform_values(members, lambda _, v: read(v))


#: What is read from an answer once, for all rules: each step's columns use those of the steps before.
_PARSED, _READ, _KNOWN = "__answer", "__read", "__known"


def prepared(df: DataFrame, case: str, answer: str) -> DataFrame:
    """``df`` with the case as a variant and the answer as it is read, in columns of their own, so that no rule reads them again."""
    raw, a = F.col(answer), F.col(_PARSED)
    members = F.try_variant_get(F.parse_json(case), "$", "map<string, variant>")
    filled = F.try_parse_json(raw).isNotNull() & raw.rlike(r"^[ \t\n\r]*\{[ \t\n\r]*[^} \t\n\r]")  # an object with a member: of JSON, its start tells
    df = df.withColumns({"__members": members, _PARSED: F.from_json(raw, ANSWER), "__usable": F.coalesce(filled, F.lit(False))})
    df = df.withColumns({"__case": axes(F.col("__members")), "__keys": F.map_keys("__members")})
    # keys are read only where there is but one memory
    owner_there = F.array_contains(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), "owner")
    single = Answer.memory(a, F.when(owner_there, a["owner"]).otherwise(a["atomic_note_owner"]))
    several = F.transform(a["memories"], lambda m: Answer.memory(m, F.coalesce(m["owner"], m["atomic_note_owner"])))
    read = F.filter(F.when(F.coalesce(F.size(a["memories"]), F.lit(0)) > 0, several).otherwise(F.array(single)), lambda m: m["note"].isNotNull())
    df = df.withColumn(_READ, read)
    once = F.filter(_READ, lambda m, i: ~F.exists(F.slice(_READ, F.lit(1), i), lambda b: F.lower(b["note"]) == F.lower(m["note"])))
    named = F.transform(listed(a["entities"], Answer.type_of("entities")), entity_of)
    lists = [named.alias("entities"), *[listed(a[n], Answer.type_of(n)).alias(n) for n in ("relations", "resources", "obsoleted_facts", "project_entries")]]
    df = df.withColumn(_KNOWN, F.struct(once.alias("memories"), *lists, a["cancels_action"].alias("cancels_action"), a["language"].alias("language"), F.coalesce(a["classification_confidence"], F.lit(1.0)).alias("confidence")))
    entities = F.col(_KNOWN)["entities"]
    facts = F.flatten(F.transform(entities, lambda e: e["facts"]))
    names = F.filter(F.flatten(F.transform(entities, lambda e: e["names"])), lambda n: n != "")
    predicates = F.transform(F.col(_KNOWN)["relations"], lambda r: F.lower(F.coalesce(r["predicate"], F.lit(""))))
    return df.withColumns({"__facts": facts, "__names": names, "__predicates": predicates})


class Answer:
    """What an answer left, from the columns of ``prepared``."""

    def __init__(self) -> None:
        a = F.col(_KNOWN)
        self.usable, self.language, self.cancels, self.confidence = F.col("__usable"), a["language"], a["cancels_action"], a["confidence"]
        self.entities, self.relations, self.resources, self.obsoleted, self.projects = (a[n] for n in ("entities", "relations", "resources", "obsoleted_facts", "project_entries"))
        self.memories, self.facts, self.names, self.predicates = a["memories"], F.col("__facts"), F.col("__names"), F.col("__predicates")
        self.has_note = (F.size(self.memories) > 0) | said(self.cancels).isNotNull()
        self.kind = F.when(F.size(self.memories) > 0, F.get(self.memories, 0)["kind"]).when(self.has_note, F.lit("note"))
        self.durable = F.size(self.facts) + F.size(self.relations)
        bare = F.size(self.relations) + F.size(self.projects) + F.size(self.resources) + F.size(self.obsoleted) + F.size(self.facts) == 0
        self.nothing = (F.size(self.memories) == 0) & (plain(self.cancels) == "") & bare

    @staticmethod
    def type_of(name: str) -> str:
        """The element type of a list of the schema."""
        start = ANSWER.index(f"{name} array<") + len(f"{name} array<")
        depth, at = 1, start
        while depth:
            depth += {"<": 1, ">": -1}.get(ANSWER[at], 0)
            at += 1
        return ANSWER[start : at - 1]

    @staticmethod
    def memory(m: Column, owner: Column) -> Column:
        kind = F.coalesce(F.when(m["kind"] != "", m["kind"]), F.when(m["atomic_note_kind"] != "", m["atomic_note_kind"]), F.lit("note"))
        note = said(F.coalesce(F.when(m["note"] != "", m["note"]), m["atomic_note"]))
        return F.struct(note.alias("note"), kind.alias("kind"), said(owner).alias("owner"), said(m["event_date"]).alias("event_date"), F.coalesce(m["event_recurring"], F.lit(False)).alias("recurring"))

    def entity(self, name: Column) -> Column:
        """The first entity of a name or alias; null if there is none."""
        return let(plain(name), lambda n: F.get(F.filter(self.entities, lambda e: F.array_contains(e["names"], n)), 0))

    def resource(self, url: Column) -> Column:
        return let(plain(url), lambda u: F.get(F.filter(self.resources, lambda r: plain(r["url"]) == u), 0))

    def born(self, name: Column) -> Column:
        """what becomes of an entity the memory does not know: created, proposed, ignored or absent."""
        n = plain(name)
        named = let(n, lambda n: F.exists(self.relations, lambda r: (plain(r["from"]) == n) | (plain(r["to"]) == n)))
        owns = let(n, lambda n: F.exists(self.resources, lambda r: plain(r["entity_canonical"]) == n))

        def becomes(e: Column) -> Column:
            strongest = F.array_max(F.transform(e["facts"], lambda f: F.coalesce(f["persistence_value"], F.lit(3))))
            gate = entity_gate(named, owns, F.size(F.coalesce(e["facts"], F.array().cast(f"array<{_FACT}>"))), strongest, plain(F.get(e["facts"], 0)["predicate"]), F.size(self.memories) > 0)
            return F.when(e.isNull(), "absent").otherwise(gate)

        return let(self.entity(name), becomes)

    def goes(self, entity: Column, predicate: Column) -> Column:
        """where the first fact of an entity with such a predicate goes: facts, pending or review; absent if there is none."""
        mine = let(plain(entity), lambda n: F.flatten(F.transform(F.filter(self.entities, lambda e: F.array_contains(e["names"], n)), lambda e: e["facts"])))
        first = let(plain(predicate), lambda p: F.get(F.filter(mine, lambda f: F.contains(plain(f["predicate"]), p)), 0))

        def lands(f: Column) -> Column:
            sure = base_confidence(F.coalesce(f["evidence_strength"], F.lit("explicit")), F.coalesce(f["persistence_value"], F.lit(3)), F.lit(False), F.lit(1))
            return F.when(f.isNull(), "absent").otherwise(destination(sure))

        return let(first, lands)


def entity_of(e: Column) -> Column:
    """An entity with what rules compare, made once: its name, all its names (aliases too), its facts without null."""
    own = plain(e["canonical_name"])
    same = [e[n].alias(n) for n in ("canonical_name", "type", "type_proposal", "renamed_to")]
    return F.struct(*same, own.alias("name"), F.concat(F.array(own), F.transform(listed(e["aliases"], "string"), plain)).alias("names"), listed(e["facts"], _FACT).alias("facts"))


def variants(wanted: Column) -> Column:
    """The words, separated by bars, any of which will do."""
    return F.filter(F.transform(F.split(wanted, r"\|"), plain), lambda v: v != "")


Found = Column | tuple[Column, Callable[[Column], Column]]


def rules(case: Case, answer: Answer, today: Column) -> list[tuple[str, Column, Found]]:
    """(gap, whether the case asks, whether it is one); for axes with several values (gap, asked, (values, which of them is one))."""
    c, a = case, answer
    memories = a.memories
    of = lambda field: F.transform(memories, lambda m: m[field])
    dates = of("event_date")
    wanted = lambda axis: F.coalesce(c.text(axis), F.lit(""))
    lower = lambda axis: F.lower(wanted(axis))
    link = lambda w: F.get(F.filter(a.relations, lambda r: F.exists(variants(w), lambda v: F.contains(F.lower(F.coalesce(r["predicate"], F.lit(""))), v))), 0)
    resource = a.resource(wanted("resource_url"))
    owner_type = let(plain(resource["entity_canonical"]), lambda n: plain(F.get(F.filter(a.entities, lambda e: e["name"] == n), 0)["type"]))
    pair = lambda axis, at: F.coalesce(F.get(F.split(c.text(axis), ":", 2), at), F.lit(""))
    goes = lambda axis: a.goes(pair(axis, 0), pair(axis, 1))
    typed = let(plain(c.text("type_proposal")), lambda n: F.filter(a.entities, lambda e: e["name"] == n))
    proposed_type = F.get(F.slice(typed, -1, 1), 0)["type_proposal"]
    snapped = lambda v: F.when(F.try_to_date(F.substring(v, 1, 10)).isNotNull() & (F.length(v) >= 10), F.concat(month_snap(F.try_to_date(F.substring(v, 1, 10)), today, a.kind, c.text("text")).cast("string"), F.substring(v, F.lit(11), F.length(v)))).otherwise(v)
    value = lambda f: F.coalesce(f["value"], F.lit(""))
    negated = F.split(wanted("obsoletes"), "=", 2)
    named = plain(F.get(negated, 0))
    of_value = plain(F.get(negated, 1))
    undone = plain(a.cancels)
    language = F.substring(F.lower(said(a.language)), 1, 2)
    on = F.map_entries(c.counts("facts_on"))
    facts_of = lambda name: let(plain(name), lambda n: F.size(F.flatten(F.transform(F.filter(a.entities, lambda e: e["name"] == n), lambda e: e["facts"]))))
    return [
        ("drop_guard", c.asks("drop_guard"), ~(a.has_note | (F.size(a.projects) > 0) | (a.durable > 0))),
        ("note", c.has("note"), ~a.has_note.eqNullSafe(c.flag("note"))),
        ("kind", c.asks("kind") & a.has_note, ~F.array_contains(F.when(F.size(memories) > 0, of("kind")).otherwise(F.array(a.kind)), wanted("kind"))),
        ("memories", c.has("memories"), ~F.size(memories).cast("double").eqNullSafe(c.number("memories"))),
        ("owner", c.has("owner"), ~F.exists(F.when(F.size(memories) > 0, of("owner")).otherwise(F.array(F.lit(None).cast("string"))), lambda o: o.eqNullSafe(c.text("owner")))),
        ("recurring", c.has("recurring"), ~F.exists(F.when(F.size(memories) > 0, of("recurring")).otherwise(F.array(F.lit(False))), lambda r: r.eqNullSafe(c.flag("recurring")))),
        ("event_date: dated", c.has("event_date") & c.text("event_date").isNull(), F.exists(dates, lambda d: d.isNotNull())),
        ("event_date", c.text("event_date").isNotNull(), ~F.coalesce(F.array_contains(dates, c.text("event_date")), F.lit(False))),
        ("language", c.has("language"), ~language.eqNullSafe(c.text("language"))),
        ("needs_review", c.has("needs_review"), ~((a.confidence < REVIEW) | a.nothing).eqNullSafe(c.flag("needs_review"))),
        ("rel", c.asks("rel"), (c.texts("rel"), lambda w: ~F.exists(variants(w), lambda v: F.exists(a.predicates, lambda p: F.contains(p, v))))),
        ("facts_on", c.asks("facts_on"), (F.transform(F.filter(on, lambda e: facts_of(e["key"]) < e["value"]), lambda e: e["key"]), lambda w: w.isNotNull())),
        ("relation_proposed: absent", c.asks("relation_proposed"), (c.texts("relation_proposed"), lambda w: link(w).isNull())),
        ("relation_proposed: certain", c.asks("relation_proposed"), (c.texts("relation_proposed"), lambda w: let(link(w), lambda r: r.isNotNull() & (F.coalesce(F.nullif(r["confidence"], F.lit(0.0)), F.lit(1.0)) >= REVIEW)))),
        ("proj", c.asks("proj"), F.size(a.projects) == 0),
        ("facts_min", c.asks("facts_min"), a.durable < c.number("facts_min")),
        ("entity_expected", c.asks("entity_expected"), (c.texts("entity_expected"), lambda w: ~F.array_contains(a.names, plain(w)))),
        ("resource_url", c.asks("resource_url"), resource.isNull()),
        ("resource_owner_type", c.asks("resource_url") & c.asks("resource_owner_type") & resource.isNotNull(), F.coalesce(owner_type, F.lit("")) != plain(c.text("resource_owner_type"))),
        ("resource_comment: extra", c.asks("resource_url") & c.has("resource_comment") & c.text("resource_comment").isNull() & resource.isNotNull(), plain(resource["user_comment"]) != ""),
        ("resource_comment: lost", c.asks("resource_url") & c.text("resource_comment").isNotNull() & resource.isNotNull(), ~F.contains(plain(resource["user_comment"]), plain(c.text("resource_comment")))),
        ("entity_proposed", c.asks("entity_proposed"), (c.texts("entity_proposed"), lambda w: a.born(w) != "proposed")),
        ("fact_proposed", c.asks("fact_proposed"), goes("fact_proposed") != "pending"),
        ("fact_asserted", c.asks("fact_asserted"), goes("fact_asserted") != "facts"),
        ("type_proposal: absent", c.asks("type_proposal"), F.size(typed) == 0),
        ("type_proposal: asserted", c.asks("type_proposal") & (F.size(typed) > 0), F.coalesce(proposed_type, F.lit("")) == ""),
        ("no_type_proposal", c.asks("no_type_proposal"), F.exists(a.entities, lambda e: F.coalesce(e["type_proposal"], F.lit("")) != "")),
        ("no_entity", c.asks("no_entity"), (c.texts("no_entity"), lambda w: F.array_contains(a.names, plain(w)))),
        ("forbidden_value", c.asks("forbidden_value"), let(lower("forbidden_value"), lambda w: F.exists(a.facts, lambda f: F.contains(F.lower(snapped(value(f))), w)))),
        ("renamed_to", c.asks("renamed_to"), ~let(plain(c.text("renamed_to")), lambda w: F.exists(a.entities, lambda e: plain(e["renamed_to"]) == w))),
        ("no_rename", c.asks("no_rename"), F.exists(a.entities, lambda e: plain(e["renamed_to"]) != "")),
        ("obsoletes", c.asks("obsoletes"), ~F.exists(a.obsoleted, lambda o: (plain(o["predicate"]) == named) & (F.coalesce(F.get(negated, 1), F.lit("")).isin("") | (plain(o["value"]) == of_value)))),
        ("no_obsolete", c.asks("no_obsolete"), F.size(a.obsoleted) > 0),
        ("cancels: unnamed", c.asks("cancels"), undone == ""),
        ("cancels: other", c.asks("cancels") & (undone != ""), ~(F.contains(undone, plain(c.text("cancels"))) | F.contains(plain(c.text("cancels")), undone))),
        ("no_cancel", c.asks("no_cancel"), undone != ""),
        ("forbidden_predicate", c.asks("forbidden_predicate"), let(lower("forbidden_predicate"), lambda w: F.exists(a.facts, lambda f: F.contains(F.lower(F.coalesce(f["predicate"], F.lit(""))), w)))),
    ]


UNUSABLE = "unusable answer"


def missing(name: str, values: Column, bad: Callable[[Column], Column]) -> Column:
    """A gap for each of the values that is bad."""
    return F.transform(F.filter(values, lambda w: F.coalesce(bad(w), F.lit(False))), lambda w: F.concat(F.lit(f"{name} "), w))


def with_gaps(df: DataFrame, case: str, answer: str, today: Column, skip: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``gaps``: those between a case and an answer, both JSON columns, in the order of the rules; axes with several values name theirs.

    An answer that is no JSON object, or an empty one, has one gap.  ``skip``: axes that another stage counts.
    """
    ready, a, parts = prepared(df, case, answer), Answer(), []
    for name, asked, found in rules(Case(F.col("__case"), F.col("__keys")), a, today):
        if name.split(":")[0] in skip:
            continue
        if isinstance(found, tuple):
            hits = missing(name, *found)
        else:
            hits = F.when(F.coalesce(found, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
        parts.append(F.when(F.coalesce(asked, F.lit(False)), hits).otherwise(F.array().cast("array<string>")))
    gaps = F.when(a.usable, F.flatten(F.array(*parts))).otherwise(F.array(F.lit(UNUSABLE)))
    return ready.withColumn("gaps", gaps).select(*df.columns, "gaps")
