"""Personal data, and information-theoretic sanitisation of the terms around it, natively.

Base kinds are found by patterns and checked. Then corpus co-occurrence tells how strongly a term reveals a protected
entity (a value found before): pointwise mutual information of term and entity over whole documents, against the
entity's information content. A term (any word outside base spans) that discloses at least the removal threshold's
share of it, in two different contexts or more, is removed wherever it occurs, in every document; from the lower
threshold on it is generalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm import spans as S
from weirgate.llm.store import BROADCAST_KEYS, heavy_join, materialize

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "term"]
#: Code points on either side of an entity that are its context; shares of its information from which on terms are generalised or removed; different contexts needed.
WINDOW, GENERALISE, REMOVE, SUPPORT = 60, 0.75, 0.9, 2
TERM = r"\p{L}++"

# A run can only be entered at its start or where the last match ended, which keeps long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds in a non-null text, by kind as listed, then start."""
    email = S.find(text, EMAIL, "email", gate=text.contains("@"))
    ip = F.filter(S.find(text, IP, "ip"), lambda s: s["value"].rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
    many = text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
    card = F.filter(S.find(text, CARD, "card", gate=many), lambda s: F.length(_digits(s["value"])).between(13, 19) & F.call_function("luhn_check", _digits(s["value"])))
    phone = F.filter(S.find(text, PHONE, "phone", gate=text.contains("+")), lambda s: F.length(_digits(s["value"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def blanked(text: Column, spans: Column) -> Column:
    """The text with every code point of the spans turned to a blank."""

    def step(state: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], state["at"])
        grown = F.concat(state["out"], F.substring(text, state["at"] + 1, begin - state["at"]), F.repeat(F.lit(" "), s["end"] - begin))
        return F.when(s["end"] > state["at"], F.struct(s["end"].alias("at"), grown.alias("out"))).otherwise(state)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def places(text: Column, clean: Column, spans: Column, window: int = WINDOW) -> Column:
    """Of every span: entity (hash of its value), context (hash of the text around it), and the terms in that.

    A word that the window's edge cuts is left out of these terms; ``clean`` is the text without what spans hold.
    """

    def around(s: Column) -> Column:
        lo = F.greatest(s["start"] - window, F.lit(0))
        more = F.length(text) > s["end"] + window

        def before(t: Column) -> Column:
            return t.substr(lo + 1, s["start"] - lo)

        def after(t: Column) -> Column:
            own = t.substr(s["end"] + 1, F.lit(window))
            return F.when(more, F.regexp_replace(own, r"\p{L}++$", "")).otherwise(own)

        whole = F.when(lo > 0, F.regexp_replace(before(clean), r"^\p{L}++", "")).otherwise(before(clean))
        return F.struct(F.xxhash64(s["value"]).alias("entity"), F.xxhash64(before(text), after(text)).alias("context"), terms_of(F.concat_ws(" ", whole, after(clean))).alias("terms"))

    return F.transform(spans, around)


def occurrences(clean: Column, actions: Column) -> Column:
    """Spans of all terms that ``actions`` (term -> action) names, in a text without what base spans hold."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        term = F.lower(piece)
        action = F.try_element_at(actions, term)
        span = F.struct(F.lit("term").alias("kind"), state["at"].alias("start"), end.alias("end"), term.alias("value"), action.alias("action"))
        return F.struct(end.alias("at"), F.when(action.isNotNull(), F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.aggregate(F.regexp_extract_all(clean, F.lit(rf"{TERM}|\P{{L}}++"), F.lit(0)), start, step, lambda s: s["out"])


_SPANS = "array<struct<kind:string,start:int,end:int,value:string,action:string>>"


def _pairs(mine: DataFrame, some: DataFrame) -> DataFrame:
    """(entity, term, context, n): co-occurrence over whole documents; the sum of n is the number of documents that have both.

    A term near some of an entity's places in a document has their contexts; one that stands elsewhere in it has one, the first of the entity's.
    """
    lists = mine.groupBy("uid").agg(F.collect_list(F.struct("entity", "places")).alias("mine"))
    each = lists.join(some.select("uid", terms_of(F.col("clean")).alias("terms")), "uid").select("terms", F.explode("mine").alias("m")).select("terms", "m.*")
    near = each.select("entity", "terms", "places", F.array_distinct(F.flatten("places.terms")).alias("near"))
    row = lambda term, context, n: F.struct(term.alias("term"), context.cast("long").alias("context"), F.lit(n).cast("long").alias("n"))
    beyond = F.transform(F.array_except("terms", "near"), lambda t: row(t, F.col("places")[0]["context"], 1))
    beside = F.transform("near", lambda t: row(t, F.lit(None), 1))
    contexts = F.flatten(F.transform("places", lambda p: F.transform(p["terms"], lambda t: row(t, p["context"], 0))))
    return near.select("entity", F.explode(F.concat(beyond, beside, contexts)).alias("t")).select("entity", "t.*")


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, most: int = BROADCAST_KEYS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, base (base spans), spans (those and ``term`` spans), actions (one for each span).

    A null text is empty; an entity that every row has carries no information and discloses nothing; repeated rows get
    equal answers; an empty table gives an empty result; other columns are ignored. Disclosing terms are broadcast while
    there are at most ``most``; more meet the texts' terms in a shuffle join.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = slim.withColumn("base", base_spans(F.col("text")))
    has = F.size("base") > 0
    found = found.withColumn("clean", F.when(has, blanked(F.col("text"), F.col("base"))).otherwise(F.col("text")))
    around = F.when(has, places(F.col("text"), F.col("clean"), F.col("base"))).otherwise(F.array().cast("array<struct<entity:bigint,context:bigint,terms:array<string>>>"))
    table = materialize(found.select("doc_id", "base", "clean", around.alias("places")).withColumn("uid", F.monotonically_increasing_id()), "pii")
    total = table.count()
    some = table.where(has)
    words = table.select("uid", F.explode(terms_of(F.col("clean"))).alias("term"))
    each = some.select("uid", F.explode("places").alias("p")).select("uid", "p.*")
    mine = materialize(each.groupBy("uid", "entity").agg(F.sort_array(F.collect_set(F.struct("context", "terms"))).alias("places")), "places")
    # an entity without several contexts has no term with them
    several = mine.select("entity", F.explode("places.context").alias("context")).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= support)
    entities = mine.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") < total).join(several, "entity").select("entity", "n_entity")
    entities = materialize(entities, "entities")
    by_context = _pairs(heavy_join(mine, entities.select("entity"), "entity"), some).groupBy("entity", "term", "context").agg(F.sum("n").alias("n"))
    joint = by_context.groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.count("context").alias("contexts")).where(F.col("contexts") >= support)
    frequency = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    counted = joint.join(frequency, "term").join(entities, "entity")
    content = F.log2(F.lit(float(max(total, 1))) / F.col("n_entity"))
    shown = F.log2(F.col("n_pair") * F.lit(float(max(total, 1))) / (F.col("n_term") * F.col("n_entity")))
    action = F.when(shown >= remove * content, "remove").when(shown >= generalise * content, "generalise")
    flagged = materialize(counted.select("term", action.alias("action")).where("action is not null").groupBy("term").agg(F.max("action").alias("action")), "disclosing")
    if flagged.count() <= most:
        hits = words.join(F.broadcast(flagged), "term")
    else:
        hits = heavy_join(materialize(words, "terms"), flagged, "term")
    actions = hits.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions"))
    based = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit("remove").alias("action")))
    marked = F.when(F.col("actions").isNotNull(), occurrences(F.col("clean"), F.col("actions"))).otherwise(F.array().cast(_SPANS))
    return table.join(actions, "uid", "left").select("doc_id", "base", S.by_kind(F.concat(based, marked), KINDS).alias("spans"))


def sanitised_text(text: Column, spans: Column) -> Column:
    """The text with base values and removed terms replaced by their kind, and generalised terms by a neutral word.

    ``spans`` are those of :func:`sanitise` for the same text. Without spans the text comes back as it is; of spans that
    begin together the shorter one counts; a null text stays null.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["action"].alias("action"))))
    return S.replace(text, ordered, lambda s: F.when(s["action"] == "generalise", "something").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
