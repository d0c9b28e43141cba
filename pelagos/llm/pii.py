"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base finds are e-mail addresses, IP addresses, card and phone numbers. Each distinct value found is a protected entity, and
so is what many values share: the domain of an address, the first half of an IP address, the first six digits of a card and
four of a phone number. The corpus then tells how strongly a term reveals an entity, with frequencies over all whole
documents. Of the documents that hold the term, the share p = n(e,t) / n(t) holds the entity too; what counts is the lower
end of p's one-sided 95 % interval (Wilson's), P, where evidence is the number of unlike surroundings (`reach` code points on
either side of the find, so that copies of one passage count once). The pointwise mutual information log2(P N / n(e)) is held
against the information of the entity itself, IC = log2(N / n(e)): PMI / IC is near 1 where the term tells of the entity,
and 0 where it says nothing. A term reveals an entity that it meets in at least `min_contexts` unlike surroundings if
PMI / IC is at least `disclosure` and P at least `risk`, that is, whoever reads the term and guesses the entity is right
with that probability. So common entities ask for more evidence than rare ones, and the rule stays the same as tables grow.
Terms are runs of three or more letters and digits, in lower case.

A term that reveals an entity is generalised to its kind where it stands in a document that holds the entity or, with
`everywhere`, in any document: elsewhere it tells of the entity as well.

Terms that cannot reach `disclosure` and `risk` with any entity, since too few of the documents that hold them hold a base
find, never meet the entities; that bound drops no term that would pass.

Positions come from cutting the text at its matches: a match begins after all pieces and matches before it.

Defined cases: null and empty texts hold nothing; every row counts once in all frequencies, repeated ones too, whatever its
doc_id, which plays no part; equal texts are treated alike; an empty table stays empty; other columns pass through, and
clashing output names raise ValueError.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.llm.tables import free, free_of, text_of, written

_MAIL = "A-Za-z0-9._%+-"
#: Kinds in order, with a pattern that finds the same as the plain one without running over a long word again and again:
#: a match begins where no longer one could have begun, or right where the last one ended (\G), and gives nothing back.
PATTERNS = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]{3,}+"
EDGE = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Bits that tell which texts may hold a listed term (1 MB); with millions of terms most do, and more texts move.
BITS = 1 << 23
SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits pass Luhn's test: every second one from the right counts twice, less 9 if over 9."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    return F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda span: _holds(kind, span["value"])


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def find_all(text: Column, pattern: str | Column, kind: str) -> Column:
    """Spans of all matches, code points, end exclusive."""
    # there is one piece more than matches: the last pair has no match
    both = F.filter(F.arrays_zip(F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")), lambda x: x["m"].isNotNull())
    walked = F.aggregate(
        both,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
            F.array_append(acc["spans"], F.struct(F.lit(kind).alias("kind"), (acc["at"] + F.length(x["p"])).alias("start"), (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"), x["m"].alias("value"))).alias("spans"),
        ),
    )
    return walked["spans"]


def base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """docs with the base finds of each whole text: by kind as listed, then start."""
    whole = text_of(text)
    none = F.array().cast(f"array<{SPAN}>")
    signs = {"email": whole.contains("@"), "ip": whole.rlike(r"[0-9]\.[0-9]"), "card": whole.rlike("[0-9](?:[ -]?[0-9]){15}"), "phone": whole.rlike(r"\+[0-9]")}
    kinds = [F.when(signs[k], F.filter(find_all(whole, p, k), _test(k))).otherwise(none) for k, p in PATTERNS.items()]
    return docs.withColumn(out, F.concat(*kinds))


def _entities(span: Column) -> Column:
    """What a find protects: the value, however it is written, and what it shares with others of its kind."""
    kind, low, digits = span["kind"], F.lower(span["value"]), _digits(span["value"])
    value = F.when(kind.isin("card", "phone"), digits).otherwise(low)
    shared = F.when(kind == "email", F.substring_index(low, "@", -1)).when(kind == "ip", F.substring_index(low, ".", 2)).when(kind == "card", F.left(digits, F.lit(6))).otherwise(F.left(digits, F.lit(4)))
    return F.array(F.concat_ws(":", kind, value), F.concat_ws(":", F.lit("all"), kind, shared))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _private(docs: DataFrame, text: str) -> DataFrame:
    """(key, text, base, n): the distinct texts that hold a base find, and how many rows have each."""
    held = base_spans(docs.select(text_of(text).alias("text")), "text").filter(F.size("base") > 0)
    return held.groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count("*").alias("n"))


def _held(private: DataFrame, reach: int, min_contexts: int) -> DataFrame:
    """(key, entity, context, n_e): the entities of each text, with one of their surroundings, of those found in enough unlike ones."""
    spans = private.select("key", "n", "text", F.explode("base").alias("span"))
    left = F.greatest(F.col("span.start") - reach, F.lit(0))
    around = F.xxhash64(F.col("text").substr(left + 1, F.col("span.start") - left), F.col("text").substr(F.col("span.end") + 1, F.lit(reach)))
    each = spans.select("key", "n", around.alias("context"), F.explode(_entities(F.col("span"))).alias("entity"))
    once = written(each.groupBy("key", "entity").agg(F.min("context").alias("context"), F.first("n").alias("n")), "pii-entities")
    contexts = once.groupBy("entity", "context").agg(F.sum("n").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("contexts"))
    return once.join(contexts.filter(F.col("contexts") >= min_contexts).select("entity", "n_e"), "entity").select("key", "entity", "context", "n", "n_e")


def _surely(share: Column, seen: Column) -> Column:
    """The lower end of the one-sided 95 % interval of a share (Wilson's), of which `seen` cases were for it."""
    z2, n = 1.645**2, seen / share
    return (share + z2 / (2 * n) - 1.645 * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def revealing_terms(docs: DataFrame, private: DataFrame, text: str, reach: int, disclosure: float, risk: float, min_contexts: int) -> DataFrame:
    """(key, term): for each text that holds base finds, the terms in it that reveal one of its entities. Counts are over all documents."""
    total = docs.count()
    least = max(risk, (min_contexts / max(total, min_contexts)) ** (1 - disclosure))
    terms = docs.select(F.explode(_terms(text_of(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    inside = private.select("key", "n", F.explode(_terms(F.col("text"))).alias("term"))
    # PMI >= disclosure IC means P >= (n(e) / N) ** (1 - disclosure); P is under n(e,t) / n(t), and n(e,t) at most the documents with finds
    able = inside.groupBy("term").agg(F.sum("n").alias("n_p"), F.count("*").alias("texts")).filter(F.col("texts") >= min_contexts).join(terms, "term").filter(F.col("n_p") >= least * F.col("n_t") * (1 - 1e-9)).select("term", "n_t")
    met = written(inside.drop("n").join(able, "term").join(_held(private, reach, min_contexts), "key"), "pii-met")
    counts = met.groupBy("entity", "term", "context").agg(F.sum("n").alias("n"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t")).groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("contexts"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    known = F.log2(F.lit(float(total)) / F.col("n_e"))
    sure = counts.withColumn("sure", _surely(F.col("n_et") / F.col("n_t"), F.col("contexts")))
    reveal = sure.filter((F.col("contexts") >= min_contexts) & (known > 0) & (F.col("sure") >= risk) & (known + F.log2("sure") >= disclosure * known)).select("entity", "term")
    return met.join(reveal, ["entity", "term"]).select("key", "term").distinct()


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Where the terms stand in the text, but for parts of base finds."""
    pattern = F.concat(F.lit(f"(?iu){EDGE[0]}(?:"), F.array_join(terms, "|"), F.lit(f"){EDGE[1]}"))  # terms are letters and digits
    apart = lambda s: F.array_contains(terms, F.lower(s["value"])) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    return F.transform(F.filter(find_all(text, pattern, "term"), apart), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value")))


def _slots(term: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(term, F.lit(k)), F.lit(BITS)) for k in range(3)]


def _bitmap(listed: DataFrame, out: str) -> DataFrame:
    """One row: BITS bits in longs, three for each listed term set. Its size is the same however long the list is."""
    marks = listed.select(F.explode(F.array(*_slots(F.col("term")))).alias("slot")).groupBy(F.expr("slot DIV 64").alias("id")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits"))
    whole = listed.sparkSession.range(BITS // 64).join(marks, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("x"))
    return written(whole.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias(out)), "pii-bitmap")


def find_private(docs: DataFrame, text: str = "text", reach: int = 80, disclosure: float = 0.7, risk: float = 0.5, min_contexts: int = 3, everywhere: bool = False) -> DataFrame:
    """docs with array columns `base` and `terms` of spans: base finds, and terms that give a protected entity away."""
    free_of(docs, "base", "terms")
    private = written(_private(docs, text), "pii-private")
    told = written(revealing_terms(docs, private, text, reach, disclosure, risk, min_contexts), "pii-told")
    key, mine, bits = (free(docs.columns, name) for name in ("key", "mine", "bits"))
    found = base_spans(docs, text).withColumn(key, F.md5(text_of(text).cast("binary")))
    # only rows that may hold a term meet the list of terms, so that most texts never move
    if everywhere:
        listed = written(told.select("term").distinct(), "pii-listed")
        bitmap = F.broadcast(_bitmap(listed, bits))
        held = lambda slot: F.getbit(F.get(F.col(bits), F.floor(slot / 64).cast("int")), (slot % 64).cast("int")) == 1
        may = F.exists(_terms(text_of(text)), lambda t: reduce(lambda a, b: a & b, map(held, _slots(t))))
        near, far = found.join(bitmap, may, "left_semi"), found.join(bitmap, may, "left_anti")
        texts = near.select(F.col(key).alias("key"), text_of(text).alias("text"))
        told = texts.select("key", F.explode(_terms(F.col("text"))).alias("term")).join(listed, "term", "left_semi").distinct()
    else:
        near, far = found.filter(F.size("base") > 0), found.filter(F.size("base") == 0)
    hits = written(told.groupBy("key").agg(F.collect_set("term").alias(mine)).withColumnRenamed("key", key), "pii-hits")  # bounded by the text
    none = F.array().cast(f"array<{SPAN}>")
    spans = F.when(F.col(mine).isNotNull(), _term_spans(text_of(text), F.col(mine), F.col("base"))).otherwise(none)
    own = [*(F.col(f"`{c}`") for c in docs.columns), F.col("base")]
    return far.select(*own, none.alias("terms")).unionByName(near.join(hits, key, "left").select(*own, spans.alias("terms")))


def spelt(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(found: DataFrame, text: str = "text", base: str = "base", terms: str = "terms") -> DataFrame:
    """The whole text with each find generalised to its kind, in square brackets; overlapping finds become the first one's kind."""
    spans = F.array_sort(F.transform(F.concat(base, terms), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    whole = text_of(text)
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], -s["end"]).alias("at"), acc["parts"].alias("parts"))).otherwise(
            F.struct((-s["end"]).alias("at"), F.array_append(acc["parts"], F.concat(whole.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("parts"))
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), whole.substr(acc["at"] + 1, F.lit(2**31 - 2) - acc["at"])),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, walked).otherwise(F.col(text).cast("string"))).drop(base, terms)
