"""PII: personal data by pattern, and information-theoretic sanitisation of the terms that give it away.

The values that the patterns find are the protected entities. Over the whole corpus, the texts that hold a term and
those that hold an entity tell how strongly the term reveals the entity. Equal texts are one observation: a page
that was copied a thousand times says no more about who stands beside whom than the page does. The share of a
term's texts that hold the entity is bounded from below (Wilson's bound, one-sided, 95 %), and a term whose bound is
``share`` or more, at a gain of ``gain_bits`` or more over the entity's own share, is a span of kind ``term`` wherever
it stands, unless a pattern's span holds it already.

The threshold comes from a stated risk: a reader who sees the term and guesses the entity must not be right more
often than wrong, so that ``share`` is one half. No entity is left out by a count of its own; the bound reaches one
half with three texts of three, six of seven or nine of twelve, whatever the size of the corpus. All of it is
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import RID, Scratch, keyed

KINDS = ["email", "ip", "card", "phone", "term"]
#: The patterns, written so that no long run of characters is tried again from each of its places: possessive
#: repeats never give back what couldn't help, and a match starts where its first run of characters starts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM_LETTERS = r"[^\x00-\x60\x7B-\x7F]"
TERM = TERM_LETTERS + r"{4,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHARE, GAIN_BITS, Z, BROADCAST_BYTES = 0.5, 4.0, 1.645, 4 << 20
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weigh(x: Column, i: Column) -> Column:
        doubled = x * 2
        return F.when(i % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(x)

    each = F.transform(F.split(F.reverse(digits), ""), lambda c: F.expr("try_cast(0 as int)") + c.try_cast("int"))
    ones = F.filter(each, lambda c: c.isNotNull())
    return F.aggregate(F.transform(ones, weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _ip_fits(value: Column) -> Column:
    part = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(part, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))


def _found(text: Column, pattern: str | Column, kind: int, may: Column, valid) -> Column:
    """Matches of one pattern as spans; ``may`` is a cheap condition without which there is none."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast(SPAN)
    gaps, hits = F.call_function("split", text, regex, F.lit(-1)), F.regexp_extract_all(text, regex, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        a = acc["at"] + F.length(pair["gap"])
        z = a + F.length(pair["hit"])
        span = F.struct(a.alias("start"), F.lit(kind).alias("kind"), z.alias("end"), pair["hit"].alias("value"))
        return F.struct(z.alias("at"), F.when(valid(pair["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(may & text.rlike(pattern) if isinstance(pattern, str) else may, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def base_spans(text: Column) -> Column:
    """The spans of all four patterns, by start and kind: code points, end exclusive."""
    digit = text.rlike("[0-9]")

    def counted(value: Column, low: int, high: int) -> Column:
        return F.length(_digits(value)).between(low, high)

    card = r"[0-9](?:[\x20-]?[0-9]){13}"
    return F.array_sort(
        F.concat(
            _found(text, EMAIL, 0, text.contains("@"), lambda v: F.lit(True)),
            _found(text, IP, 1, digit, _ip_fits),
            _found(text, CARD, 2, digit & text.rlike(card), lambda v: counted(v, 14, 19) & _luhn(_digits(v))),
            _found(text, PHONE, 3, text.contains("+"), lambda v: counted(v, 10, 15)),
        )
    )


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


def lower_bound(k: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of a share seen as k of n."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _observed(docs: DataFrame, base: DataFrame, scratch: Scratch) -> DataFrame:
    """docs without the rows whose text an earlier row has, by 64-bit hashes that base holds as ``t``."""
    copied = base.groupBy("t").agg(F.min(RID).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "first")
    later = scratch.write(base.select(RID, "t").join(copied, "t").where(F.col(RID) != F.col("first")).select(RID), "later")
    return docs.join(later, RID, "left_anti")


def revealing_terms(docs: DataFrame, base: DataFrame, scratch: Scratch, share: float = SHARE, gain_bits: float = GAIN_BITS) -> DataFrame:
    """``term`` and its strongest ``share`` (lower bound) and ``gain`` in bits, from all distinct texts.

    docs: RID, text; base: RID, t (hash of the text), spans. A term with more than twice the texts of an entity can't
    reach a share of one half with it, nor in general one with over 1 / share times as many; such pairs aren't made, so
    that a long text of many entities pairs them only with its rare terms.
    """
    observed = _observed(docs, base, scratch)
    entity = F.transform("spans", lambda s: F.concat_ws(":", s["kind"].cast("string"), F.translate(s["value"], UPPER, LOWER)))
    held = base.where(F.size("spans") > 0).groupBy("t").agg(F.min(RID).alias(RID), F.first("spans").alias("spans")).select(RID, F.explode(F.array_distinct(entity)).alias("entity"))
    held = scratch.write(held, "held")
    least = next((n for n in range(1, 10_000) if n / (n + Z * Z) >= share), 1 << 62)  # with fewer texts the bound is below share even for n of n
    often = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= least)
    lists = scratch.write(held.join(often, "entity").groupBy(RID).agg(F.array_sort(F.collect_list(F.struct("n_entity", "entity"))).alias("e")), "lists")
    counts = observed.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where(F.col("n_term") >= least)
    near = observed.join(lists.select(RID, F.array_max("e")["n_entity"].alias("most")), RID).select(RID, "most", F.explode(_terms(F.col("text"))).alias("term"))
    rare = near.join(scratch.write(counts, "counts"), "term").where(F.col("n_term") * share <= F.col("most")).select(RID, "term", "n_term")
    may = F.filter("e", lambda e: e["n_entity"] >= F.col("n_term") * share)
    pairs = rare.join(lists, RID).select("term", "n_term", F.explode(may).alias("e")).select("term", "n_term", "e.n_entity", "e.entity")
    both = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term"))
    bound, total = lower_bound(F.col("n_both"), F.col("n_term")), observed.count()
    gain = F.log2(F.col("n_both") / F.col("n_term") * F.lit(float(total)) / F.col("n_entity"))
    over = both.select("term", bound.alias("share"), gain.alias("gain")).where((F.col("share") >= share) & (F.col("gain") >= gain_bits))
    return over.groupBy("term").agg(F.max("share").alias("share"), F.max("gain").alias("gain"))


def spans_of(docs: DataFrame, share: float = SHARE, gain_bits: float = GAIN_BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """RID and ``spans`` (start, kind, end, value), in order, of each row of docs (RID, text). A null text is empty."""
    scratch = Scratch(docs.sparkSession)
    whole = docs.select(RID, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = scratch.write(whole.select(RID, F.xxhash64("text").alias("t"), base_spans(F.col("text")).alias("spans")), "base")
    terms = scratch.write(revealing_terms(whole, base, scratch, share, gain_bits), "terms").select("term")
    base = base.drop("t")
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0]
    if not size:
        return base
    listed = F.broadcast(terms) if size <= broadcast_bytes else terms
    hits = whole.select(RID, F.explode(_terms(F.col("text"))).alias("term")).join(listed, "term").groupBy(RID).agg(F.array_join(F.array_sort(F.collect_list("term")), "|").alias("any"))
    pattern = F.concat(F.lit(f"(?<!{TERM_LETTERS})(?:"), F.col("any"), F.lit(f")(?!{TERM_LETTERS})"))
    low = F.translate(F.col("text"), UPPER, LOWER)
    more = whole.join(hits, RID).select(RID, _found(low, pattern, 4, F.lit(True), lambda v: F.lit(True)).alias("more"))
    clear = F.filter("more", lambda m: ~F.exists("spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    return base.join(more, RID, "left").select(RID, F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", clear))).alias("spans"))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256 and spans of each row of docs.

    A null or empty text has no spans. Equal texts count once as evidence and get equal spans. An empty
    table gives an empty table; other columns of docs are ignored.
    """
    have = keyed(docs.select("doc_id", "text"))
    found = spans_of(have, **thresholds)
    own = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    rows = have.select(RID, "doc_id").join(found, RID)
    based = F.sha2(_named(F.filter("spans", lambda s: s["kind"] < 4)), 256)
    return rows.select("doc_id", *[own(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], based.alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """docs with each span of its text replaced by its kind, as in <EMAIL>; all columns stay, a null text too."""
    have = keyed(docs)
    found = spans_of(have.select(RID, "text"), **thresholds).where(F.size("spans") > 0).withColumnRenamed("spans", "__wg_spans")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["end"] <= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] < acc["at"], F.lit("")).otherwise(F.element_at(names, s["kind"] + 1))
        return F.when(inside, acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, mark).alias("out")))

    done = F.aggregate("__wg_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    changed = have.join(found, RID, "left").withColumn("text", F.when(F.col("__wg_spans").isNull(), text).otherwise(done))
    return changed.select(*docs.columns)
