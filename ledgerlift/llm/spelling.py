"""Spelling variants of frequent words, joined by asymmetric q-chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import stored


def _cut(word: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end``, from 0."""
    return F.substring(word, start + 1, end - start)


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def _chunks(word: Column, size: Column) -> list[Column]:
    """The chunk side: a key for either half of a word, together with either half of the other half.

    The two halves are the chunks. Where one is preserved, the edit is in the other, of which again one of
    two chunks is preserved.
    """
    q, zero = _half(size), F.lit(0)
    keys = []
    for chunk, (a, b, low, high) in enumerate(((zero, q, q, size), (q, size, zero, q))):
        middle = low + _half(high - low)
        for part, (c, d) in enumerate(((low, middle), (middle, high))):
            keys.append(F.xxhash64(size, F.lit(chunk), F.lit(part), _cut(word, a, b), _cut(word, c, d)))
    return keys


def _grams(word: Column, size: Column) -> list[Column]:
    """The gram side: the positional grams of a word, one code point longer than the chunk side's, that a chunk
    there can equal, each at its place or one later, where the code point more is in what lies before."""
    short = size - 1
    q, zero = _half(short), F.lit(0)
    keys = []
    for chunk, (a, b, low, high) in enumerate(((zero, q, q, size), (q + 1, size, zero, q + 1))):
        step = _half(high - low - 1)
        for part, (c, d) in enumerate(((low, low + step), (low + step + 1, high))):
            keys.append(F.xxhash64(short, F.lit(chunk), F.lit(part), _cut(word, a, b), _cut(word, c, d)))
    return keys


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of words that differ by exactly one inserted, deleted or replaced code point.

    ``words`` has ``word`` (different strings of four code points or more) and ``n``. Returns each pair once:
    ``a``, ``b``, ``n_a``, ``n_b``, where ``a`` is the shorter, or the smaller of two of one length.

    One word of a pair contributes two disjoint chunks, the other its positional grams: one edit cannot touch
    both chunks, so one is found at its place or, behind an insertion, one place later. The half with the edit
    is treated likewise, so a key covers three quarters of a word and a bucket holds words that differ in
    the last quarter only; candidates stay few even where half of a vocabulary begins alike. The join is on the
    keys' hashes, and each candidate is verified.
    """
    size = F.length("word")
    chunks = words.select("word", "n", F.explode(F.array(*_chunks(F.col("word"), size))).alias("key"))
    grams = words.select(
        "word", "n", F.explode(F.array(*_chunks(F.col("word"), size), *_grams(F.col("word"), size))).alias("key")
    )
    a, b = F.col("a"), F.col("b")
    found = chunks.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "key").join(
        grams.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "key"), "key"
    ).where((F.length(b) > F.length(a)) | (F.length(b) == F.length(a)) & (a < b))
    found = found.where(F.levenshtein(a, b, 1) == 1)
    # A pair meets under every key that its edit leaves alone.
    return found.groupBy("a", "b").agg(F.any_value("n_a").alias("n_a"), F.any_value("n_b").alias("n_b"))


def follow(links: DataFrame) -> DataFrame:
    """``word`` and ``root``: where each word's chain of links (``word``, ``root``) ends. Links form no circle.

    Each round replaces a link by the link of its target, so chains are followed in steps that double. Rounds
    are written to the shared folder; a flag reaches the driver.
    """
    links = stored(links.select("word", "root"), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(links.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def group_spellings(words: DataFrame, *, factor: int = 10) -> DataFrame:
    """The accepted spelling of each word.

    ``words`` has ``word`` and ``n``, its number of occurrences; other columns are ignored. A word's form is
    its near word (see ``near_words``) with the largest ``n``, the smallest by code points among equals, if
    that is ``factor`` * its own ``n`` or more (``factor`` above 1); its root is where forms lead in the end.

    Returns ``word``, ``form`` (null if none), ``root`` (the word itself if none), ``n``, ``n_near`` and
    ``form_n``, all numbers long. Rows of one word count together; null words, null counts and words of
    fewer than four code points, which have too little for four chunks, are left out. An empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent than its variants")
    known = stored(
        words.where((F.length("word") >= 4) & F.col("n").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n")),
        "words",
    )
    pairs = near_words(known)
    ways = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )
    near = pairs.select(F.explode(ways).alias("way")).select("way.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("top")
    )
    top_n = -F.col("top.less")
    is_form = top_n >= factor * F.col("n")
    done = known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("top.word")).alias("form"), F.when(is_form, top_n).alias("form_n"),
    )
    done = stored(done, "forms")
    roots = follow(done.where("form is not null").select("word", F.col("form").alias("root")))
    return done.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(
    docs: DataFrame, *, at_least: int = 7, twice: int = 2, slip: int | None = None, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``word`` and ``n``: runs of letters (``LETTERS``, only A to Z lower-cased) of all texts, of ``at_least``
    code points and ``twice`` occurrences or more.

    With ``slip`` a word gets a misspelling at random places, for trials: where that number divides the
    CRC-32 of ``<id>:<lower-cased run>``, the code point at the CRC modulo the run's length is left out. A null id
    reads as an empty one there. A null text has no words; an empty table gives no rows. Occurrences are
    combined before they are shuffled.
    """
    # A maximal run of fewer letters gives no word, so it is not cut out at all.
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{LETTERS}{{{at_least},}}"), F.lit(0))
    words = docs.select(F.col(f"`{id}`").cast("string").alias("id"), F.explode(runs).alias("run")).select(
        "id", F.translate("run", _UPPER, _LOWER).alias("run")
    )
    if slip is not None:
        crc = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        words = words.withColumn("h", crc)
        at = F.pmod("h", F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        words = words.select(F.when(F.col("h") % slip == 0, shorter).otherwise(F.col("run")).alias("run"))
    counted = words.where(F.length("run") >= at_least).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= twice)
