"""Removal of lines that repeat, also with a few edits, anywhere in a corpus.

Segment-partition join: a line of n characters is cut into ``max_edits`` + 1 segments. If two
lines are within ``max_edits`` edits, one segment of the shorter is found unchanged in the
longer, and not far from its own place (multi-match-aware selection). Each line is entered
under its own segments and probes, for each length up to ``max_edits`` shorter, the few
substrings that can match there. Lines that meet are compared by a banded bit-parallel
edit distance. Everything is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurekit.llm.links import connect, pairs_between, shared_buckets
from featurekit.llm.tables import id_and_text, let, written

MAX_EDITS = 2
#: Shorter lines have no near copies.
MIN_CHARS = 20
#: Exact copies of lines from this length on are repeats, if they hold a letter or digit.
EXACT_CHARS = 1
#: Slots of the broadcast that thins the lines before their texts are joined.
_SLOTS = 1 << 20
_STRIP = 32
_LETTERS = "etaonisrhldcumfp"


def lines_of(docs: DataFrame, min_chars: int, exact_chars: int | None = None) -> DataFrame:
    """(doc_id, line_no, line, sign_a, sign_b) of the lines that are long enough for near
    copies, or for exact ones. Equal lines share their 128-bit sign."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    enough = F.length("line") >= min_chars
    if exact_chars is not None:
        enough |= (F.length("line") >= exact_chars) & F.col("line").rlike(r"[\p{L}\p{N}]")
    return rows.where(enough).withColumns(
        {"sign_a": F.xxhash64("line"), "sign_b": F.xxhash64(F.lit(1), "line")}
    )


def segment_keys(line: Column, max_edits: int) -> Column:
    """Hashes of (length, segment, substring) that a line enters or probes.

    Of a length that falls into ``max_edits`` + 1 segments, the last ones are a character
    longer. The cuts are a list that one small expression goes through: spelt out, they
    would be a method too large for the JVM to compile.
    """
    parts, cuts = max_edits + 1, []
    for shorter in range(max_edits + 1):
        for i in range(parts):
            # i edits at most lie before the segment, max_edits - i after it.
            low = max(-i, shorter - (max_edits - i))
            high = min(i, shorter + (max_edits - i))
            cuts += [(shorter, i, shift) for shift in range(low, high + 1)]

    def keys(size: Column) -> Column:
        def key(cut: Column) -> Column:
            length, i = size - cut["shorter"], cut["i"]
            short = F.floor(length / parts).cast("int")
            first_longer = short * parts + parts - length
            start = i * short + F.greatest(i - first_longer, F.lit(0)) + cut["shift"] + 1
            own = short + F.when(i >= first_longer, 1).otherwise(0)
            # In very short lines a cut may leave the line; its hash then only meets more.
            return F.xxhash64(length, i, F.substring(line, start, own))

        listed = ", ".join(f"named_struct('shorter', {a}, 'i', {b}, 'shift', {c})" for a, b, c in cuts)
        return F.transform(F.expr(f"array({listed})"), key)

    return let(F.length(line), keys)


def _without_equal_start(a: Column, b: Column) -> Column:
    """(a, b) without the blocks that both begin with."""
    blocks = F.floor(F.least(F.length(a), F.length(b)) / _STRIP).cast("int")
    each = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))

    def cut(text: Column, i: Column) -> Column:
        return F.substring(text, i * _STRIP + 1, F.lit(_STRIP))

    same = F.aggregate(
        each, F.lit(0), lambda n, i: F.when((n == i * _STRIP) & (cut(a, i) == cut(b, i)), n + _STRIP).otherwise(n)
    )
    return let(
        same,
        lambda n: F.struct(
            F.substring(a, n + 1, F.length(a)).alias("a"), F.substring(b, n + 1, F.length(b)).alias("b")
        ),
    )


def _characters(text: Column) -> Column:
    """An empty text has none, although it splits into one empty string."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _reached(a: Column, b: Column, max_edits: int) -> Column:
    """Whether two arrays of characters are at most ``max_edits`` edits apart.

    Bit d of the state for e edits says that, after j characters of a, j + d - max_edits
    characters of b are matched with e edits at most: a band of 2 max_edits + 1 diagonals
    in one number.
    """
    band = (1 << (2 * max_edits + 1)) - 1

    def step(state: Column, x: Column) -> Column:
        j = state["j"]
        equal = F.lit(0)
        for d in range(2 * max_edits + 1):
            # An index out of range gives null, which is no match.
            hit = F.coalesce(F.get(b, j + (d - max_edits)) == x, F.lit(False))
            equal = equal.bitwiseOR(F.when(hit, 1 << d).otherwise(0))

        def states(equal: Column) -> Column:
            fields, before, lower = [(j + 1).alias("j")], None, None
            for e in range(max_edits + 1):
                old = state[f"r{e}"]
                new = old.bitwiseAND(equal)
                if e:
                    moved = F.shiftright(before, 1).bitwiseOR(F.shiftleft(lower, 1))
                    new = new.bitwiseOR(before).bitwiseOR(moved).bitwiseAND(F.lit(band))
                before, lower = old, new
                fields.append(new.alias(f"r{e}"))
            return F.struct(*fields)

        return let(equal, states)

    start = [F.lit(0).alias("j")]
    start += [F.lit(((1 << (e + 1)) - 1) << max_edits & band).alias(f"r{e}") for e in range(max_edits + 1)]
    end = F.aggregate(a, F.struct(*start), step)[f"r{max_edits}"]
    return F.call_function("shiftright", end, F.size(b) - F.size(a) + max_edits).bitwiseAND(F.lit(1)) == 1


def within_edits(a: Column, b: Column, max_edits: int) -> Column:
    """Whether two texts are at most ``max_edits`` edits apart. Blocks that are equal at
    both ends are cut off before, which leaves the distance as it is."""

    def tails(ab: Column) -> Column:
        return _without_equal_start(F.reverse(ab["a"]), F.reverse(ab["b"]))

    def compare(ab: Column) -> Column:
        both = F.struct(_characters(ab["a"]).alias("a"), _characters(ab["b"]).alias("b"))
        return let(both, lambda c: _reached(c["a"], c["b"], max_edits))

    found = let(_without_equal_start(a, b), lambda ab: let(tails(ab), compare))
    return F.when(F.abs(F.length(a) - F.length(b)) <= max_edits, found).otherwise(F.lit(False))


def letter_counts(line: Column) -> Column:
    """How often some letters occur. An edit changes the counts by 2 in sum at most."""
    size = F.length(line)
    return F.array(*[size - F.length(F.replace(line, F.lit(c))) for c in _LETTERS])


def _sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def pair_sketch(line: Column, max_edits: int) -> Column:
    """Numbers whose bits the line's character pairs flip. An edit changes four pairs at
    most, so the sketches of two alike lines differ in 4 ``max_edits`` bits at most, and as
    there is one number more than that, in one number not at all."""
    parts = 4 * max_edits + 1

    def numbers(hashed: Column) -> Column:
        def number(part: Column) -> Column:
            own = F.filter(hashed, lambda h: F.pmod(h, F.lit(parts)) == part)
            bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int"))
            return F.aggregate(own, F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(bit(h)))

        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), number)

    places = F.sequence(F.lit(1), F.greatest(F.length(line) - 1, F.lit(1)))
    return let(F.transform(places, lambda i: F.xxhash64(F.substring(line, i, F.lit(2)))), numbers)


def repeated_lines(
    docs: DataFrame,
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    exact_chars: int | None = None,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, line_no, n_chars, first_doc_id, first_line_no) of every line, from 0, whose
    class holds two lines at least.

    Lines end at ``\\n``. Lines of ``min_chars`` characters or more are linked if they are at
    most ``max_edits`` edits (insert, delete, replace a character) apart; a class is what
    links reach, and its first line is the one of smallest (doc_id, line_no). With
    ``exact_chars``, equal lines from that length on that hold a letter or digit are linked
    too, however short; without, shorter lines than ``min_chars`` are left out. Null and empty
    texts have no such line; rows without doc_id are left out; rows that repeat a doc_id
    are the same document, so that their lines at the same place are one line. Long texts
    take part whole.

    A line that very many documents share is counted map-side and joins the near-copy
    search once.
    """
    read = id_and_text(docs, doc_id, text).where("doc_id IS NOT NULL")
    lines = lines_of(read, min_chars, exact_chars)
    long = F.length("line") >= min_chars
    signs = ["sign_a", "sign_b"]
    counted = written(
        lines.groupBy(*signs).agg(
            F.min(F.struct("doc_id", "line_no")).alias("first"),
            (F.min(F.struct("doc_id", "line_no")) < F.max(F.struct("doc_id", "line_no"))).alias("repeats"),
            F.max(long).alias("long"),
        ).where("repeats OR long").drop("long")
    )

    distinct = lines.where(long).groupBy(*signs).agg(F.first("line").alias("line"))
    keys = distinct.select(F.explode(segment_keys(F.col("line"), max_edits)).alias("key"), F.col("sign_a").alias("id"))
    buckets = shared_buckets(keys)
    slots = buckets.select(F.pmod("id", F.lit(_SLOTS)).alias("slot")).distinct()
    # At most _SLOTS numbers.
    thinned = lines.where(long).join(F.broadcast(slots), F.pmod("sign_a", F.lit(_SLOTS)) == F.col("slot"), "left_semi")
    involved = buckets.select(F.col("id").alias("sign_a")).distinct()
    texts = thinned.join(involved, "sign_a", "left_semi").groupBy(F.col("sign_a").alias("id")).agg(F.first("line").alias("line"))
    texts = written(texts.withColumn("letters", letter_counts(F.col("line"))))
    letters = _sum_of(F.zip_with("a_letters", "b_letters", lambda x, y: F.abs(x - y))) <= 2 * max_edits

    def alike(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("id").alias("a"), F.col("line").alias("a_line"), F.col("letters").alias("a_letters"))
        b = texts.select(F.col("id").alias("b"), F.col("line").alias("b_line"), F.col("letters").alias("b_letters"))
        near = within_edits(F.col("a_line"), F.col("b_line"), max_edits)
        return pairs.join(a, "a").join(b, "b").where(F.when(letters, near).otherwise(F.lit(False))).select("a", "b")

    def between(rows: DataFrame) -> DataFrame:
        # Rows of a bucket meet again only where a number of their sketches is equal.
        apart = texts.join(rows.select("id").distinct(), "id")
        sketches = written(apart.select("id", "letters", pair_sketch(F.col("line"), max_edits).alias("sketch")))
        sketched = rows.join(sketches, "id")
        each = sketched.select("key", "id", "class", "letters", "sketch", F.posexplode("sketch").alias("part", "number"))
        each = each.select(F.xxhash64("key", "part", "number").alias("key"), "id", "class", "letters", "sketch")
        xor = F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return pairs_between(each, letters & (_sum_of(xor) <= 4 * max_edits))

    linked = connect(buckets, alike, between).select(F.col("id").alias("sign_a"), "component")
    near = counted.join(linked, "sign_a")
    firsts = near.groupBy("component").agg(F.min("first").alias("class_first"))
    near = near.join(firsts, "component").select(*signs, "class_first")
    exact = counted.where("repeats").join(near, signs, "left_anti").select(*signs, F.col("first").alias("class_first"))
    classes = written(near.unionByName(exact))
    places = lines.select("doc_id", "line_no", F.length("line").alias("n_chars"), *signs)
    return places.join(classes, signs).select(
        "doc_id", "line_no", "n_chars",
        F.col("class_first.doc_id").alias("first_doc_id"), F.col("class_first.line_no").alias("first_line_no"),
    )


def drop_repeated_lines(
    docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None
) -> DataFrame:
    """The documents (doc_id, text, other columns) without the lines that repeat an earlier
    one, as :func:`repeated_lines` finds them. Documents of which nothing but white space is
    left go; empty and null texts that were so before stay, as do rows without doc_id."""
    found = repeated_lines(docs, max_edits, min_chars, exact_chars)
    repeats = found.where("doc_id != first_doc_id OR line_no != first_line_no")
    dropped = repeats.groupBy("doc_id").agg(F.collect_set("line_no").alias("_dropped"))
    names = [c for c in docs.columns if c != "_dropped"]
    joined = docs.select(*[F.col(f"`{c}`") for c in names]).join(dropped, "doc_id", "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_dropped"))
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    joined = joined.withColumn("text", F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(text))
    return joined.where(F.col("_dropped").isNull() | (F.trim("text") != "")).select(*[F.col(f"`{c}`") for c in names])
