"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Patterns find the protected entities (email, ip, card, phone).  A term, a word of letters outside all entities, may reveal one
as well, wherever in the document it stands.  Over all documents, with ``n`` of them,

* ``p(e)`` is the share that hold entity e, ``p(e|t)`` the share of term t's documents that hold e;
* the disclosure of e by t is ``log(p(e|t) / p(e)) / log(1 / p(e))``: the part of e's information that t gives away, 1 where
  t always comes with e, 0 where it says nothing.

A term that discloses an entity to ``THRESHOLD`` or more, if at least ``SUPPORT`` different texts hold the two together, is a span of
kind ``term`` at each of its occurrences, in documents without the entity too.  Entity spans are replaced by their kind, terms
are generalised to ``[TERM]``.  A term in more than ``n_entity / p(e) ** (1 - THRESHOLD)`` documents cannot reach the threshold,
as no more than ``n_entity`` of them hold e; such pairs are never made.

A span's place is found by cutting the text at the matches and adding up lengths.  Java's possessive forms of the patterns
match the same strings as the plain ones, without their cost on long runs; that of the card begins where a run of digits does
and leaves out runs of under 14 digits, which are no cards.  Spans and entities are found once and written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import materialize

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}++"
THRESHOLD, SUPPORT = 0.8, 2
STEP = 64
#: Words of 64 bits of the filter that tells which texts may hold a disclosing term: a bounded number of rows.
FILTER_WORDS = 1 << 18


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, at: Column) -> Column:
        d = F.substring(back, at + 1, F.lit(1)).cast("int")
        return total + F.when(at % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, "[.]"), lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.ltrim(p, F.lit("0")).try_cast("int")).otherwise(999), F.lit(0)) <= 255)
    if kind == "card":
        digits = _digits(x)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _lengths(found: Column, gaps: Column) -> Column:
    """Lengths of the matches ``found``, each with the piece before it."""
    return F.transform(found, lambda x, i: (F.char_length(F.get(gaps, i)) + F.char_length(x)).cast("long"))


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda s, v: s + v)


def _sums(found: Column, lengths: Column) -> Column:
    """Sums of the lengths before each block of ``STEP``."""
    return F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STEP).cast("int")),
        F.array(F.lit(0).cast("long")),
        lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + _total(F.slice(lengths, b * STEP + 1, STEP)))),
    )


def places(found: Column, gaps: Column, lengths: Column | None = None, sums: Column | None = None, chosen: Column | None = None) -> Column:
    """Structs (start, end, value) of the matches ``found`` between the pieces ``gaps``, or of those numbered in ``chosen``;
    positions in code points.

    Where matches are many, ``lengths`` and ``sums`` must be columns: an expression is worked out again for each match.
    """
    lengths = _lengths(found, gaps) if lengths is None else lengths
    sums = _sums(found, lengths) if sums is None else sums

    def place(x: Column, i: Column) -> Column:
        block = F.floor(i / STEP).cast("int")
        start = F.get(sums, block) + _total(F.slice(lengths, block * STEP + 1, i % STEP)) + F.char_length(F.get(gaps, i))
        return F.struct(start.alias("start"), (start + F.char_length(x)).alias("end"), x.alias("value"))

    return F.transform(found, place) if chosen is None else F.transform(chosen, lambda i: place(F.get(found, i), i))


def _of_kind(number: int, kind: str, found: Column) -> Column:
    valid = F.filter(found, lambda s: _valid(kind, s["value"]))
    return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def _count(number: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")


def with_base_spans(texts: DataFrame) -> DataFrame:
    """``texts`` with ``base``: structs (start, kind, end, value) of the entities in ``text``, kinds by number."""
    nothing, spans = F.array().cast("array<string>"), []
    hints = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    out = texts.withColumn("digits", F.col("text").rlike("[0-9]"))
    columns = {f"{kind}_found": F.when(hints.get(kind, F.col("digits")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(nothing) for kind, pattern in PATTERNS.items()}
    out = out.withColumns(columns)
    # columns of their own, as they would else be found anew for each match
    out = out.withColumns({f"{kind}_gaps": F.when(F.size(f"{kind}_found") > 0, F.split("text", pattern, -1)) for kind, pattern in PATTERNS.items()})
    out = out.withColumns({f"{kind}_lengths": _lengths(F.col(f"{kind}_found"), F.col(f"{kind}_gaps")) for kind in PATTERNS})
    out = out.withColumns({f"{kind}_sums": F.when(F.size(f"{kind}_found") > 0, _sums(F.col(f"{kind}_found"), F.col(f"{kind}_lengths"))) for kind in PATTERNS})
    for n, kind in enumerate(PATTERNS):
        found = places(*(F.col(f"{kind}_{part}") for part in ("found", "gaps", "lengths", "sums")))
        spans.append(_of_kind(n, kind, F.when(F.size(f"{kind}_found") > 0, found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))))
    return out.withColumn("base", F.array_sort(F.concat(*spans))).select(*texts.columns, "base")


def outside() -> Column:
    """The text with blanks in place of its entities, so that positions stay."""

    def piece(s: Column, i: Column) -> Column:
        done = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.array_max(F.slice("ends", F.lit(1), i)))
        gap = F.substring("text", (done + 1).cast("int"), F.greatest(s["start"] - done, F.lit(0)).cast("int"))
        return F.concat(gap, F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], done), F.lit(0)).cast("int")))

    text = F.concat(F.array_join(F.transform("base", piece), ""), F.substring("text", (F.array_max("ends") + 1).cast("int"), F.length("text")))
    return F.when(F.size("base") > 0, text).otherwise(F.col("text"))


def with_outside(based: DataFrame) -> DataFrame:
    """``based`` with ``outside``, the text without its entities."""
    return based.withColumn("ends", F.transform("base", lambda s: s["end"])).withColumn("outside", outside()).drop("ends")


def with_entities(based: DataFrame) -> DataFrame:
    """``based`` with ``text_key``, a digest of the text, and the distinct ``entities``."""
    kinds = F.array(*map(F.lit, KINDS))
    entities = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), F.lower(s["value"]))))
    return based.withColumns({"text_key": F.sha1("text"), "entities": entities})


def with_terms(based: DataFrame) -> DataFrame:
    """``text_key, entities`` and the distinct ``terms`` of each whole text.  They are found again where they are needed: that is
    cheaper than to write them all."""
    out = with_outside(based).withColumn("found", F.array_distinct(F.regexp_extract_all("outside", F.lit(TERM), F.lit(0))))
    return out.select("text_key", "entities", F.array_distinct(F.transform("found", F.lower)).alias("terms"))


def disclosing(held: DataFrame, threshold: float, support: int) -> DataFrame:
    """``term`` of those whose disclosure of some entity reaches the threshold, from counts over all documents."""
    n = held.select("entities").count()
    entities = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    # one document more than the bound, as the powers are rounded
    most = F.col("n_entity") / F.pow(F.col("n_entity") / n, F.lit(1 - threshold)) + 1
    entities = materialize(entities.where((F.col("n_entity") >= support) & (F.col("n_entity") < n)).withColumn("most", most), "pii-entities")
    bound = entities.agg(F.coalesce(F.max("most"), F.lit(0.0)).alias("most")).first()["most"]
    terms = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    terms = materialize(terms.where((F.col("n_term") >= support) & (F.col("n_term") <= bound)), "pii-terms")
    # rows of one text count together, so that copies of it are read once
    whose = held.where(F.size("entities") > 0).select("text_key", F.explode("entities").alias("entity")).groupBy("text_key", "entity").agg(F.count("*").alias("n_rows"))
    whose = materialize(whose.join(entities, "entity"), "pii-whose")
    rows = held.where(F.size("entities") > 0).join(whose.select("text_key").distinct(), "text_key", "left_semi")
    said = materialize(rows.select("text_key", F.explode("terms").alias("term")).distinct().join(terms, "term"), "pii-said")
    pairs = whose.join(said, "text_key").where(F.col("n_term") <= F.col("most"))
    # copies of a text say the same thing again, so support is a number of different texts; shares are of all documents
    together = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("n_rows").alias("n_both"), F.count("*").alias("n_texts")).where(F.col("n_texts") >= support)
    p_entity, p_given = F.col("n_entity") / n, F.col("n_both") / F.col("n_term")
    return together.where(F.log(p_given / p_entity) / F.log(1 / p_entity) >= threshold).select("term").distinct()


def with_spans(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """``row, text, base, spans``: each row of ``docs`` as a struct, its text (null as empty), and sorted structs (start, kind,
    end) of its entities and, in ``spans``, of the terms that disclose one as well; kinds by number.

    Rows are told apart by a digest of their text, so equal texts get equal spans.
    """
    texts = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    based = materialize(with_entities(with_base_spans(texts)), "pii-based", "zstd")
    held = with_terms(based)
    telling = materialize(disclosing(held, threshold, support), "pii-telling")
    hits = held.select("text_key", F.explode("terms").alias("term")).join(telling, "term").groupBy("text_key").agg(F.collect_set("term").alias("telling"))
    hits = materialize(hits, "pii-hits")
    marked = may_hold(based.drop("entities"), hits)
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    without = marked.where("not may_hold").select("row", "text", plain.alias("base"), plain.alias("spans"))
    out = with_outside(marked.where("may_hold").drop("may_hold").join(hits, "text_key", "left"))
    hit = F.col("telling").isNotNull()
    # columns of their own, as they would else be found anew for each of their elements
    out = out.withColumn("found", F.when(hit, F.regexp_extract_all("outside", F.lit(TERM), F.lit(0)))).withColumn("gaps", F.when(hit, F.split("outside", TERM, -1)))
    out = out.withColumn("lengths", _lengths(F.col("found"), F.col("gaps")))
    out = out.withColumn("sums", F.when(F.size("found") > 0, _sums(F.col("found"), F.col("lengths"))))
    # places of terms alone, as adding up lengths for every word costs more than all else here
    told = F.transform("found", lambda x, i: F.when(F.array_contains("telling", F.lower(x)), i))
    out = out.withColumn("chosen", F.filter(told, lambda i: i.isNotNull()))
    terms = F.transform(places(*map(F.col, ("found", "gaps", "lengths", "sums", "chosen"))), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), s["end"].alias("end")))
    spans = F.array_sort(F.concat(plain, F.when(hit, terms).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    return out.select("row", "text", plain.alias("base"), spans.alias("spans")).unionByName(without)


def may_hold(based: DataFrame, hits: DataFrame) -> DataFrame:
    """``based`` with ``may_hold``: false only for texts that are not among the hits, so that these need not be shuffled.

    The filter is a table of at most ``FILTER_WORDS`` words of bits, set by hashes of the hits' keys; where very many hits fill
    it, all texts may hold one and all are joined.
    """
    slot = F.pmod(F.xxhash64("text_key"), F.lit(64 * FILTER_WORDS))
    place = lambda df: df.withColumn("word", F.floor(slot / 64).cast("int")).withColumn("bit", (slot % 64).cast("int"))
    bits = place(hits.select("text_key")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    bits = materialize(bits, "pii-filter")
    marked = place(based).join(F.broadcast(bits), "word", "left")  # at most FILTER_WORDS rows
    return marked.withColumn("may_hold", F.coalesce(F.getbit("bits", F.col("bit")) == 1, F.lit(False))).drop("word", "bit", "bits")


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row.

    Ids may be null or repeat; a null text counts as empty and has no spans.  Other columns are not read, and an empty table
    gives no rows.  Very long texts are searched whole.
    """
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", threshold, support)
    counts = [_count(n).alias(f"n_{kind}") for n, kind in enumerate(PATTERNS)]
    return found.select("row.doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def scrub(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """``docs`` with the spans of each text replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]`` or ``[TERM]``.

    Where spans overlap, the first one's label stands for both.  Null texts stay null, and empty ones empty.  ``length_col``,
    if the table has it, is set to the new length.  All other columns stay, whatever their names; repeated rows change alike
    and stay; an empty table gives no rows.
    """
    found = with_spans(docs, text_col, threshold, support).withColumn("ends", F.transform("spans", lambda s: s["end"]))
    marks = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS))

    def piece(s: Column, i: Column) -> Column:
        done = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.array_max(F.slice("ends", F.lit(1), i)))
        gap = F.substring("text", (done + 1).cast("int"), F.greatest(s["start"] - done, F.lit(0)).cast("int"))
        return F.when(s["start"] >= done, F.concat(gap, F.get(marks, s["kind"]))).otherwise(F.lit(""))

    text = F.concat(F.array_join(F.transform("spans", piece), ""), F.substring("text", (F.array_max("ends") + 1).cast("int"), F.length("text")))
    old = F.col("row").getField(text_col)
    out = found.withColumn("scrubbed", F.when(F.size("spans") > 0, text).otherwise(old))
    new = {text_col: F.col("scrubbed")}
    if length_col in docs.columns:
        new[length_col] = F.char_length("scrubbed").cast(docs.schema[length_col].dataType)
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
