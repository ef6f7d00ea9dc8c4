"""Personal data: labelers vote on candidate spans, their reliabilities are estimated, a classifier decides.

DataFrame functions only: what runs on the driver is a table of vote patterns of fixed size.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, documents, fresh, named

#: The base kinds in their order and their patterns. Possessive repeats and the guards before a
#: first character change no match; they keep the search linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?=(?:[0-9][ -]?){13}[0-9])[0-9](?:[ -]?[0-9])*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Further kinds that the method may add.
ADDED = {
    "local_phone": r"(?<![0-9A-Za-z+.-])(?<!\) )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_/+.@-])(?=[A-Za-z_/+-]*[0-9])(?=[0-9_/+-]*[A-Za-z])[A-Za-z0-9_/+-]{20,}+(?![@.])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
}
#: Words that stand near personal data.
GAZETTEER = r"(?i)\b(?:mail|phone|call|tel|telefon|mobile|fax|contact|key|token|secret|password|passwd|pwd|auth|api|iban|account|konto|compte|cuenta|card|bank)\b"
KINDS = [*BASE, *ADDED]
LABELERS = ["strict", "gazetteer", "assigned", "alphabet", "apart"]


#: Code points before a span that labelers look at, and how many matches before it can stand in them (the shortest one has five).
NEAR, BACK = 32, 7


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running(numbers: Column, block: int = 256) -> Column:
    """Sums up to each number and with it. Blocks are summed first, so that n numbers take n * ``block`` steps and not n * n."""
    cut_up = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(x) / block).cast("int") - 1)), lambda b: F.slice(x, b * block + 1, F.lit(block)))
    inside = lambda b, before: F.transform(b, lambda _, j: before + total(F.slice(b, F.lit(1), j + 1)))
    return let(numbers, lambda x: let(cut_up(x), lambda blocks: let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(blocks, lambda b, i: let(total(F.slice(sums, F.lit(1), i)), lambda before: inside(b, before)))))))


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, text, before>> in code points; ``before``: the ``NEAR`` code points that stand before a match.

    What stands between matches and the matches' own lengths add up to their places. What stands before one is put together from the gaps and matches
    before it, so that the whole text isn't walked for each.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    ends = lambda parts: F.transform(parts, lambda x: F.right(x, F.lit(NEAR)))

    def before(m: Column, g: Column, i: Column) -> Column:
        part = lambda x, k: F.coalesce(F.get(x, i - k), F.lit(""))
        return F.right(F.concat(*(part(x, k) for k in range(BACK, 0, -1) for x in (g, m)), part(g, 0)), F.lit(NEAR))

    def places(m: Column, g: Column) -> Column:
        lengths = F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda x, y: F.length(x) + F.length(y))
        near = let(ends(m), lambda mt: let(ends(g), lambda gt: F.transform(m, lambda _, i: before(mt, gt, i))))
        return F.zip_with(F.zip_with(m, running(lengths), lambda x, end: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("text"))), near, lambda p, x: F.struct(p["start"], p["end"], p["text"], x.alias("before")))

    return let(matches, lambda m: let(gaps, lambda g: places(m, g)))


def starting_before(spans: Column, end: Column) -> Column:
    """How many of some spans, sorted by start, start before ``end``; found by halving."""

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))
        return F.when(a["lo"] >= a["hi"], a).when(F.get(spans, mid)["start"] < end, right).otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda a: a["lo"])


def touches(s: Column, spans: Column) -> Column:
    """Whether ``s`` has a code point in common with one of ``spans``, which don't overlap and are sorted: the last one that starts before its end tells."""
    return let(starting_before(spans, s["end"]), lambda n: F.coalesce(F.get(spans, n - 1)["end"] > s["start"], F.lit(False)))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check of payment cards."""
    places = F.sequence(F.lit(1), F.length(number))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


#: What a base match has to pass.
CHECKS = {
    "email": lambda t: F.lit(True),
    "ip": lambda t: F.forall(F.split(t, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda t: F.length(digits(t)).between(14, 19) & luhn(digits(t)),
    "phone": lambda t: F.length(digits(t)).between(10, 15),
}


def spans(text: Column, kind: str, pattern: str, check=None, need: Column | None = None) -> Column:
    """Matches of a kind that pass its check, as array<struct<start, kind, end, text, before>> (kind by number, for sorting)."""
    found = find(text, pattern)
    if check:
        found = F.filter(found, lambda s: check(s["text"]))
    found = F.transform(found, lambda s: F.struct(s["start"], F.lit(KINDS.index(kind)).alias("kind"), s["end"], s["text"], s["before"]))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,text:string,before:string>>")
    return F.when(need, found).otherwise(none) if need is not None else found


def candidates(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: ``row`` (its columns without the text), ``base`` (spans of the base kinds), ``anchor`` (the same with the
    labelers' votes) and ``more``: further candidates that touch no base span, with votes."""
    digit = F.col("_t").rlike("[0-9]")
    need = {"email": F.col("_t").contains("@"), "ip": digit, "card": F.col("_t").rlike("[0-9](?:[ -]?[0-9]){13}"), "phone": F.col("_t").contains("+"), "local_phone": digit, "secret": digit, "iban": digit}
    rest = [named(c) for c in docs.columns if c not in ("text", "base", "found")]
    spare = F.lit(None).cast("int").alias(fresh(docs, "_none"))  # a struct needs a field
    rows = docs.select(F.struct(*rest, spare).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    rows = rows.select("row", *(spans(F.col("_t"), k, p, CHECKS[k], need[k]).alias(k) for k, p in BASE.items()), F.concat(*(spans(F.col("_t"), k, p, None, need[k]) for k, p in ADDED.items())).alias("added"))
    free = F.filter("added", lambda s: ~reduce(lambda x, y: x | y, (touches(s, F.col(k)) for k in BASE)))
    rows = rows.select("row", F.array_sort(F.concat(*BASE)).alias("all"), F.array_sort(free).alias("more"))

    def vote(s: Column) -> Column:
        before, t = s["before"], s["text"]
        number, letters = F.length(digits(t)), F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
        strict = (
            F.when(s["kind"] < len(BASE), F.lit(True))
            .when(s["kind"] == KINDS.index("secret"), t.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,})$"))
            .when(s["kind"] == KINDS.index("local_phone"), t.rlike("^(?:\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\\1[0-9]{4})$"))
            .otherwise(number >= 10)
        )
        votes = {
            "strict": strict,
            "gazetteer": before.rlike(GAZETTEER),
            "assigned": before.rlike("[=:][ \"']*$"),
            "alphabet": F.when(s["kind"] == KINDS.index("secret"), (number >= 4) & (letters >= 4)).otherwise(number >= 8),
            "apart": before.rlike("(?:^|[ \\n\\t\"'(=:])$") | (s["start"] == 0),
        }
        code = sum((F.when(votes[n], 1 << i).otherwise(0) for i, n in enumerate(LABELERS)), F.lit(0))
        return F.struct(s["start"], s["kind"], s["end"], s["text"], code.cast("int").alias("votes"))

    plain = F.transform("all", lambda s: F.struct(s["start"], s["kind"], s["end"], s["text"]))
    return rows.select("row", plain.alias("base"), F.transform("more", vote).alias("more"), F.transform("all", vote).alias("anchor"))


#: Labelers that say something about base spans; the others abstain there. On the added kinds all of them vote.
ON_BASE = ("strict", "apart")


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 200) -> dict[tuple[int, int], float]:
    """Probability that a (kind, votes) pattern is personal data, by expectation-maximisation over how often each occurs.

    Two hidden classes; each labeler has a rate of voting yes in either, and each kind a share of true spans. It starts from
    the share of yes votes; base kinds are known to be true, and there only the labelers of ``ON_BASE`` are counted. No labeler is taken to be worse than
    chance: its rate of yes among true spans isn't below that among the others, so one more yes never lowers a probability. Then a logistic
    span classifier over votes (no negative weights) and kinds is fitted to the class probabilities; its answers are returned.
    """
    if not counts:
        return {}
    k, base = len(LABELERS), lambda kind: kind < len(BASE)
    votes = lambda p: [(i, p[1] >> i & 1) for i in range(k) if not base(p[0]) or LABELERS[i] in ON_BASE]
    true = {p: 1.0 if base(p[0]) else 0.1 + 0.8 * sum(v for _, v in votes(p)) / k for p in counts}
    for _ in range(rounds):
        # counts of (yes, all) for true and other spans, each begun with a little of what a fair labeler does
        seen = [[[1.5, 2.0], [0.5, 2.0]] for _ in range(k)]
        share: dict[int, list[float]] = {}
        for p, n in counts.items():
            w = math.sqrt(n) if base(p[0]) else n  # anchors inform, but don't outnumber the rest
            s = share.setdefault(p[0], [1.0, 2.0])
            s[0], s[1] = s[0] + w * true[p], s[1] + w
            for i, v in votes(p):
                for c, part in enumerate((true[p], 1 - true[p])):
                    seen[i][c][0] += w * part * v
                    seen[i][c][1] += w * part
        rates = []
        for (y1, n1), (y0, n0) in seen:
            a, b = y1 / n1, y0 / n0
            a, b = (a, b) if a >= b else ((y1 + y0) / (n1 + n0),) * 2
            rates.append((min(max(a, 0.02), 0.98), min(max(b, 0.02), 0.98)))
        new = {}
        for p in counts:
            part = share[p[0]][0] / share[p[0]][1]
            odds = math.log(part / max(1e-9, 1 - part)) + sum(math.log(rates[i][0] / rates[i][1]) if v else math.log((1 - rates[i][0]) / (1 - rates[i][1])) for i, v in votes(p))
            new[p] = 1.0 if base(p[0]) else 1 / (1 + math.exp(-min(50, max(-50, odds))))
        moved = max(abs(new[p] - true[p]) for p in counts)
        true = new
        if moved < 1e-7:
            break
    return _classifier({p: n for p, n in counts.items() if not base(p[0])}, true)


def _classifier(counts, true, rounds: int = 3000) -> dict[tuple[int, int], float]:
    """A ridge-penalised logistic model over votes (weights of 0 or more) and the added kinds, fitted by gradient steps to soft labels; its answer for every pattern."""
    kinds = range(len(BASE), len(KINDS))
    x = lambda p: [1.0, *(float(p[1] >> i & 1) for i in range(len(LABELERS))), *(float(p[0] == j) for j in kinds)]
    w, rows = [0.0] * (1 + len(LABELERS) + len(kinds)), [(x(p), n, true[p]) for p, n in counts.items()]
    every = float(sum(n for _, n, _ in rows)) or 1.0
    answer = lambda v: 1 / (1 + math.exp(-min(50, max(-50, sum(a * b for a, b in zip(w, v, strict=True))))))
    for _ in range(rounds):
        grad = [1e-4 * v for v in w]
        for v, n, t in rows:
            e = n / every * (answer(v) - t)
            grad = [g + e * f for g, f in zip(grad, v, strict=True)]
        w = [v - 1.0 * g for v, g in zip(w, grad, strict=True)]
        w = [max(0.0, v) if 1 <= i <= len(LABELERS) else v for i, v in enumerate(w)]
    return {p: answer(x(p)) for p in itertools.product(kinds, range(1 << len(LABELERS)))}


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` (without the text) with ``base`` and ``found``: arrays of (start, kind, end, text), by start, then kind.

    Base spans are those of the fixed patterns that pass their checks; ``found`` has these and the candidates the classifier takes. Null or
    empty text has none. Places are code points, the end exclusive. Rows are judged by themselves, so ids may be null or repeat; all other
    columns stay, whatever their names (dots too) (``base`` and ``found`` are replaced).
    The classifier is fitted on counts of vote patterns over all documents (7 kinds x 32 patterns at most).
    """
    rows = cut(candidates(docs), "pii")
    one = rows.select(F.explode(F.concat("anchor", "more")).alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n"))
    p = reliabilities({(r["kind"], r["votes"]): r["n"] for r in one.collect()})  # 7 x 32 rows at most
    take = [k * 32 + v for (k, v), x in sorted(p.items()) if x >= threshold]
    taken = F.filter("more", lambda s: F.array_contains(F.lit(take).cast("array<int>") if take else F.array().cast("array<int>"), s["kind"] * 32 + s["votes"]))
    plain = F.transform(taken, lambda s: F.struct(s["start"], s["kind"], s["end"], s["text"]))
    rest = [c for c in docs.columns if c not in ("text", "base", "found")]
    return rows.select(*(F.col("row").getField(c).alias(c) for c in rest), "base", F.array_sort(F.concat("base", plain)).alias("found"))


def joined(column: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    rows = personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(n, BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"), F.size("found").cast("long").alias("n_spans"), (F.size("found") > 0).alias("private"))


__all__ = ["BASE", "KINDS", "candidates", "joined", "op5_personal_data", "personal_data", "reliabilities"]
