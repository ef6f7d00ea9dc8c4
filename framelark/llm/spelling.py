"""Words one edit apart, found by an even-partition pigeonhole join, and the form each of them stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, documents, release

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame) -> DataFrame:
    """A row for each maximal run of letters of each text: doc_id, run (A-Z lower-cased). Null and empty texts have none."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))


def without_point(run: Column, at: Column) -> Column:
    """``run`` without its code point number ``at`` (from 0)."""
    return F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + F.lit(2)))


def damaged(runs: DataFrame, every: int) -> DataFrame:
    """``runs`` where one code point is lost whenever ``every`` divides the crc32 of ``doc_id:run``; a null doc_id loses none."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(h, F.char_length("run").cast("long")).cast("int")
    return runs.select("doc_id", F.when(F.pmod(h, F.lit(every)) == 0, without_point(F.col("run"), at)).otherwise(F.col("run")).alias("run"))


def vocabulary(runs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: distinct runs of at least ``least_length`` code points that occur at least ``least_count`` times in all."""
    long_enough = runs.where(F.char_length("run") >= least_length)
    return long_enough.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _slice(word: Column, start: Column, length: Column) -> Column:
    return F.substr(word, start + F.lit(1), length)


def _keys(word: Column, length: Column, longer: int) -> Column:
    """Keys of a word in the index of words of ``length`` code points; ``longer`` is 1 for a word that has one more than those.

    Words of a length are cut evenly in two segments. One edit leaves one of them whole: the first stands at its place, the second
    is shifted by ``longer``. What is left around it holds the edit, so that it is cut evenly again and
    one of its two pieces is whole as well, with the same shift. A key is the segment and that piece, so a segment
    that very many words share (a common beginning or ending) is spread over the pieces beside it.
    """
    first = F.floor(length / F.lit(2)).cast("int")
    second = length - first
    shift = F.lit(longer)
    out = []
    for segment, whole, rest_start, rest in ((1, _slice(word, F.lit(0), first), first, second), (2, _slice(word, first + shift, second), F.lit(0), first)):
        left = F.floor(rest / F.lit(2)).cast("int")
        for piece, text in ((1, _slice(word, rest_start, left)), (2, _slice(word, rest_start + left + shift, rest - left))):
            out.append(F.xxhash64(length, F.lit(segment), whole, F.lit(piece), text))
    return F.array(*out)


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words exactly one inserted, deleted or replaced code point apart, each once: a, n_a, b, n_b.

    The index holds every word under the keys of its own length. Every word probes the words of its length and those
    one code point shorter with its shifted substrings. The edit is verified inside the join, so that only true pairs
    come out of it; a pair found through several keys is left once.
    """
    sized = words.select("word", "n", F.char_length("word").alias("size"))
    index = sized.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "size", F.explode(_keys(F.col("word"), F.col("size"), 0)).alias("key"))
    equal = sized.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("size").alias("of"), F.explode(_keys(F.col("word"), F.col("size"), 0)).alias("key"))
    longer = sized.where(F.col("size") > 1).select(F.col("word").alias("b"), F.col("n").alias("n_b"), (F.col("size") - 1).alias("of"), F.explode(_keys(F.col("word"), F.col("size") - 1, 1)).alias("key"))
    probe = equal.unionByName(longer).withColumnRenamed("key", "probe_key")
    one_edit = (F.char_length("b") > F.col("size")) | (F.col("a") < F.col("b"))
    found = index.join(probe, (F.col("key") == F.col("probe_key")) & (F.col("size") == F.col("of")) & one_edit & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "n_a", "b", "n_b").distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 2) -> DataFrame:
    """``words`` with n_near, form, form_n: the near word of largest n (ties: smallest in code-point order), if that is ``ratio`` times n or more."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("r")).select("r.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    ruled = -F.col("best.m") >= F.col("n") * ratio
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ruled, F.col("best.other")).alias("form"), F.when(ruled, -F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root for the words that have a form: the last word that following forms leads to.

    Every form is at least twice as frequent, so chains end, within the logarithm of the largest n. Each round replaces
    a word's pointer by its pointer's pointer, which halves the chains.
    """
    at = cut(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = cut(at.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "spelling-roots")
        release(at)
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        path = moved.framelark_path
        at = moved.select("word", "root")
        at.framelark_path = path


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Group spelling variants of ``words`` (word, n; every word once): word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; n_near counts a word's near words. Its
    form is the near word of largest n, if that is at least ``ratio`` times its own n; ties go to the smallest word in
    code-point order. root is where following forms ends, the word itself if it has no form. A null word is dropped; other columns
    are ignored. No words give no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or chains of forms may not end")
    words = words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n"))
    formed = cut(forms(words, near_pairs(words), ratio), "spelling-forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, every: int | None = None, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """Spelling variants among the letter runs of whole texts; ``every`` loses code points on purpose (see ``damaged``).

    Null and empty texts have no words; rows that repeat count each time; a null doc_id counts like others. Only ``doc_id`` and ``text`` are read.
    """
    runs = letter_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    words = cut(vocabulary(runs if every is None else damaged(runs, every), least_length, least_count), "spelling-words")
    return spelling_variants(words, ratio)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return document_variants(documents(spark, sf_dir), every=97)
