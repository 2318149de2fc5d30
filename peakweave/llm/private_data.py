"""Operator 3: personal data and what gives it away, in DataFrame functions only.

Four kinds of personal data are found by patterns. Then the corpus tells how much a term discloses: for a
protected value e and a term t near it, the pointwise mutual information log2(N n(e,t) / (n(e) n(t))) over
documents is compared with the information of e itself, log2(N / n(e)); their quotient is 1 where seeing t
tells e for sure. Terms above one threshold are generalised in the documents that hold e, above a
higher one removed. Documents without a protected value keep every term.

Positions in a text come from running sums over the lengths of its matches and of what stands between them, taken
in chunks, and stretches of a text from blocks of it: arrays only grow within a chunk, and no stretch is sought from
the text's beginning, so a text with very many matches takes little more than time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.session import written


KINDS = ("email", "ip", "card", "phone")
#: Each match starts where no longer one could (or right behind the last match), and repeats never give back; both keep the scan of a long run linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Characters on either side of a protected value whose terms may disclose it.
REACH = 64
WORD, LETTERS = r"\p{L}+", 3
#: Different texts that must hold value and term together; shares of the value's information from which a term is generalised, or removed.
SUPPORT, GENERALISE, REMOVE = 5, 0.8, 0.95
#: Terms up to which a side is broadcast (a term is no longer than the reach, 64 characters); beyond, both sides are shuffled.
BROADCAST_TERMS = 50_000
#: A text's blocks have 2 ** so many characters.
BLOCK_BITS = 10


def _let(fn, **values: Column) -> Column:
    """fn of a struct of the values, which are evaluated once however often fn's lambdas use them."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), fn)[0]


def _running(values: Column, op) -> Column:
    """op (sum or maximum of two) over the values so far, at each place of an array of ints that aren't negative.

    Chunks of about the square root of the array's length run on their own first.
    """
    zero = F.lit(0)
    along = lambda part: F.slice(F.aggregate(part, F.array(zero), lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x))), F.lit(2), F.size(part))
    after = lambda chunks: F.aggregate(chunks, F.array(zero), lambda acc, c: F.array_append(acc, op(F.element_at(acc, -1), F.element_at(c, -1))))
    joined = lambda s: F.flatten(F.zip_with(s["chunks"], F.slice(s["before"], F.lit(1), F.size(s["chunks"])), lambda c, b: F.transform(c, lambda x: op(b, x))))
    chunked = lambda s: F.transform(F.sequence(zero, F.floor((F.size(s["v"]) - 1) / s["step"]).cast("int")), lambda k: along(F.slice(s["v"], k * s["step"] + 1, s["step"])))
    whole = _let(lambda s: _let(lambda t: _let(joined, chunks=t["chunks"], before=after(t["chunks"])), chunks=chunked(s)), v=values, step=F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(values)))).cast("int"))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<int>"))


def _blocks(text: Column) -> Column:
    """The text in blocks of 2 ** BLOCK_BITS characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << BLOCK_BITS}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end, taken from the blocks that hold them."""
    size = 1 << BLOCK_BITS

    def part(k: Column) -> Column:
        first = F.greatest(start - k * size, F.lit(0))
        return F.substr(F.get(blocks, k), first + 1, F.least(end - k * size, F.lit(size)) - first)

    inner = F.transform(F.sequence(F.shiftright(start, BLOCK_BITS), F.shiftright(end - 1, BLOCK_BITS)), part)
    return F.when(end > start, F.array_join(inner, "")).otherwise("")


def _valid(kind: str, m: Column) -> Column:
    """Whether a match is one of its kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)

    def luhn(total: Column, i: Column) -> Column:
        x = F.substr(digits, i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when((F.length(digits) - i) % 2 == 0, twice).otherwise(x)

    checks = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), luhn)
    return F.length(digits).between(12, 19) & (checks % 10 == 0)


def _placed(text: Column, pattern: str, fields) -> Column:
    """What ``fields`` makes of (start, end, match) of each match of the pattern, in order."""
    lengths = lambda gaps, m: F.zip_with(F.slice(F.transform(gaps, F.length), F.lit(1), F.size(m)), m, lambda g, x: g + F.length(x))
    ends = lambda s: _let(lambda t: F.zip_with(t["m"], t["end"], lambda m, e: fields(e - F.length(m), e, m)), m=s["m"], end=_running(lengths(s["gaps"], s["m"]), lambda a, b: a + b))
    return _let(ends, m=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps=F.split(text, pattern, -1))


_SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>"


def _places(kind: str, text: Column) -> Column:
    """Spans of the valid matches."""
    fields = lambda start, end, m: F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), m.alias("value"))
    return F.when(text.rlike(HINTS[kind]), F.filter(_placed(text, PATTERNS[kind], fields), lambda s: _valid(kind, s["value"]))).otherwise(F.array()).cast(_SPAN)


def base_spans(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """id, text (null as empty), hash (of the text), the columns to keep, and found: the spans of all kinds by start, then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"), *(keep or []))
    return out.select("*", F.array_sort(F.concat(*[_places(k, F.col("text")) for k in KINDS])).alias("found"))


def _near(blocks: Column, length: Column, s: Column, reach: int) -> Column:
    """The terms within reach of a span, lower-cased, without the span itself."""
    before = _cut(blocks, F.greatest(F.lit(0), s["start"] - reach), s["start"])
    after = _cut(blocks, s["end"], F.least(length, s["end"] + reach))
    # a word that the reach cuts is no term: the window's outer edge must be a word's edge or the text's
    before = F.when(s["start"] > reach, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
    after = F.when(length > s["end"] + reach, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
    return _terms(F.concat(before, F.lit("\n"), after))


def _terms(text: Column) -> Column:
    """The different words of LETTERS letters or more, lower-cased."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\p{{L}}{{{LETTERS},}}"), F.lit(0))), F.lower))


def disclosing_terms(marked: DataFrame, texts_: DataFrame, total: int, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(kind, value, term, share): terms that disclose a protected value.

    marked: id, hash and near, one row per protected value in a text with the terms around it. texts_: the texts of the whole
    corpus, total in number, over which terms are counted. Every count is exact.
    """
    pairs = marked.select("id", "hash", "kind", "value", F.explode("near").alias("term")).distinct()
    held = marked.select("id", "hash", "kind", "value").distinct().groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_value"))
    # a term occurs in as many texts at least as it does near protected values; one that is too frequent already there can't reach the share
    seen = pairs.select("id", "hash", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_seen"))
    by_text = pairs.groupBy("kind", "value", "term", "hash").agg(F.count(F.lit(1)).alias("n"))
    joint = by_text.groupBy("kind", "value", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("different")).filter(F.col("different") >= support)
    joint = joint.join(held, ["kind", "value"]).join(seen, "term")
    joint = joint.filter(F.col("n_seen") <= F.col("both") * F.pow(total / F.col("n_value"), F.lit(1 - least)) * 1.000001)
    joint = written(joint.select("kind", "value", "term", "both", "n_value").coalesce(8), "term-candidates")
    # counted before they are joined: one row a term, not one an occurrence
    counted = texts_.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    out = (F.broadcast(joint) if joint.count() <= BROADCAST_TERMS else joint).join(counted, "term")
    own = F.log2(total / F.col("n_value"))
    mutual = F.log2(F.col("both") * total / (F.col("n_value") * F.col("n_term")))
    share = F.when(own > 0, mutual / own).otherwise(0.0)
    return out.select("kind", "value", "term", share.alias("share")).filter(F.col("share") >= least)


def disclosed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, reach: int = REACH) -> DataFrame:
    """tid, thash and telling, the terms with their shares, of the texts that hold terms to be generalised or removed: a written table."""
    around = lambda s: F.transform(s["found"], lambda x: F.struct(x["kind"].alias("kind"), F.lower(x["value"]).alias("value"), _near(s["blocks"], s["length"], x, reach).alias("near")))
    near = _let(around, found=F.col("found"), blocks=_blocks(F.col("text")), length=F.length("text"))
    near = F.when(F.size("found") > 0, near).otherwise(F.array().cast("array<struct<kind:string,value:string,near:array<string>>>"))
    spans = written(base_spans(docs, id_col, text_col).select("id", "hash", F.inline(near)), "private-values")
    texts_ = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    telling = written(disclosing_terms(spans, texts_, docs.count(), support, generalise).coalesce(8), "disclosing-terms")
    side = F.broadcast(telling) if telling.count() <= BROADCAST_TERMS else telling
    each = spans.select("id", "hash", "kind", "value").distinct().join(side, ["kind", "value"]).groupBy("id", "hash", "term").agg(F.max("share").alias("share"))
    flagged = each.groupBy("id", "hash").agg(F.collect_list(F.struct("term", "share")).alias("telling"))
    return written(flagged.select(F.col("id").alias("tid"), F.col("hash").alias("thash"), "telling").coalesce(32), "disclosed-texts")


def all_spans(marked: DataFrame, flagged: DataFrame) -> DataFrame:
    """marked (id, hash, text, found, ...) with all: base and term spans by start, then kind; term spans that overlap a base span are left out."""
    few = (flagged.agg(F.sum(F.size("telling"))).first()[0] or 0) <= BROADCAST_TERMS
    joined = marked.join(F.broadcast(flagged) if few else flagged, F.col("id").eqNullSafe(F.col("tid")) & (F.col("hash") == F.col("thash")), "left").drop("tid", "thash")
    kind = "array<struct<start:int,kind_no:int,end:int,kind:string,share:double,word:string>>"
    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(0.0).cast("double").alias("share"), F.lit("").alias("word"))).cast(kind)
    fields = lambda start, end, m: F.struct(start.alias("start"), F.lit(len(KINDS)).alias("kind_no"), end.alias("end"), F.lit("term").alias("kind"), F.lit(0.0).cast("double").alias("share"), m.alias("word"))

    def told(s: Column) -> Column:
        words = F.filter(s["words"], lambda w: (F.length(w["word"]) >= LETTERS) & F.array_contains(s["terms"], F.lower(w["word"])))
        share = lambda w: F.element_at(F.filter(s["telling"], lambda t: t["term"] == F.lower(w["word"])), 1)["share"]
        return F.transform(words, lambda w: w.withField("share", share(w)))

    words = _let(told, words=_placed(F.col("text"), WORD, fields), telling=F.col("telling"), terms=F.transform("telling", lambda t: t["term"])).cast(kind)
    both = F.array_sort(F.concat(base, words))
    # in order of starts, a word is free if no base span before it ends behind its start, and none behind it starts before its end
    is_base = lambda s: s["kind_no"] < len(KINDS)
    length = F.length("text")
    before = lambda s: _running(F.transform(s["both"], lambda x: F.when(is_base(x), x["end"]).otherwise(0)), F.greatest)
    behind = lambda s: F.reverse(_running(F.reverse(F.transform(s["both"], lambda x: F.when(is_base(x), s["length"] - x["start"]).otherwise(0))), F.greatest))

    def free(s: Column) -> Column:
        each = F.zip_with(s["both"], F.arrays_zip(s["before"], s["behind"]), lambda x, y: F.struct(x.alias("x"), (is_base(x) | ((y["before"] <= x["start"]) & (s["length"] - y["behind"] >= x["end"]))).alias("keep")))
        return F.transform(F.filter(each, lambda e: e["keep"]), lambda e: e["x"])

    merged = _let(lambda s: _let(free, both=s["both"], length=s["length"], before=before(s), behind=behind(s)), both=both, length=length)
    return joined.withColumn("all", F.when(F.col("telling").isNull(), base).otherwise(merged)).drop("telling")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """One row per input row: id_col, n_email, n_ip, n_card, n_phone, n_term, base_spans, spans (lists as text; code points, end exclusive).

    Null text counts as empty and has no spans; a null id is kept. Very long texts are searched whole. Repeated rows each get a
    row ; an empty table gives an empty table; columns of other names
    are not read.
    """
    out = all_spans(base_spans(docs, id_col, text_col), disclosed_texts(docs, id_col, text_col, **thresholds))
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(F.col("id").alias(id_col), *[count("all", k) for k in (*KINDS, "term")], listed(F.col("found")).alias("base_spans"), listed(F.col("all")).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **thresholds) -> DataFrame:
    """The table with personal data in the text replaced by its kind ([EMAIL], ...), and disclosing terms generalised or removed.

    A term is generalised to what kind of word it is: [NAME] with a capital first letter, else [TERM]. A text without spans
    stays as it is, null too. Repeated rows each stay; an empty table gives an empty table; columns of any other name are kept.
    """
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    marked = base_spans(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), whole), "__id", "__text", ["row"])
    out = all_spans(marked, disclosed_texts(docs, id_col, text_col, **thresholds))

    def label(s: Column) -> Column:
        general = F.when(F.substr(s["word"], F.lit(1), F.lit(1)).rlike(r"\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[TERM]"))
        return F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["share"] >= remove, F.lit("")).otherwise(general)

    def rewritten(s: Column) -> Column:
        # a span that starts before an earlier one ends is covered by that one's label
        fresh = F.zip_with(s["all"], F.slice(s["upto"], F.lit(1), F.size(s["all"])), lambda x, at: F.when(x["start"] >= at, F.concat(_cut(s["blocks"], at, x["start"]), label(x))).otherwise(""))
        return F.concat(F.array_join(fresh, ""), _cut(s["blocks"], F.element_at(s["upto"], -1), s["length"]))

    upto = F.concat(F.array(F.lit(0)), _running(F.transform("all", lambda x: x["end"]), F.greatest))
    text = F.when(F.size("all") > 0, _let(rewritten, all=F.col("all"), upto=upto, blocks=_blocks(F.col("text")), length=F.length("text"))).otherwise(F.col("row")[text_col])
    return out.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])
