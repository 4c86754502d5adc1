"""Personal data: fixed forms seed lexical patterns, and patterns that keep company with known data find unseen identifiers.

Base spans of the four kinds are found by their forms alone. The words around them are patterns; every text is then
searched for words that stand in such patterns and look like identifiers, and Spark scores the graph of patterns and
instances in rounds: a pattern is as good as what it meets in all its occurrences, plain words included, and an instance
as good as the patterns it stands in. Instances of trusted patterns seed the next patterns, until none is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopgauge.llm.shared import stored, whole_text
from shopgauge.llm.words import SAME, pieces, shingles, text_bytes, word_hashes

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive, so that long runs are read once: what follows a run can't begin inside it
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@_#/\\]")
_GAP = frozenset(" \t\n\v\f\r")
_PUNCTUATION = ".,;:!?()[]{}<>\"'|"
_DOT = r"(?:[ \t]?[(\[{<][ \t]?(?:dot|\.)[ \t]?[)\]}>][ \t]?|[ \t]dot[ \t]|\.)"
_DOT_BEFORE = re.compile(r"(?:[ \t]?[(\[{<][ \t]?(?:dot|\.)[ \t]?[)\]}>][ \t]?|[ \t]dot[ \t])\Z", re.I)
_DOT_WORD = re.compile(r"[ \t(\[{<]dot[ \t)\]}>]|[(\[{<][ \t]?\.", re.I)
_AT = re.compile(r"[(\[{<][ \t]?(?:at|@)[ \t]?[)\]}>]|[ \t]at[ \t]|@", re.I)
_SPELLED = re.compile(
    rf"[ \t]?[(\[{{<][ \t]?(?:at|@)[ \t]?[)\]}}>][ \t]?[\w-]++(?:{_DOT}[^\W\d_][\w-]*+)*+"
    rf"|(?:[ \t]at[ \t]|@)[\w-]++(?:{_DOT}[^\W\d_][\w-]*+)++", re.I)
_EDGE = _GAP | frozenset(",;:!?()[]{}<>\"|")
_DIGITS = r"(?:\([0-9]++\)|[0-9]++)(?:[-./]?(?:\([0-9]++\)|[0-9]++))*+(?=[.,;:!?()\[\]{}<>\"'|]*+(?:[ \t\n\v\f\r]|\Z))"
_GROUP = re.compile(_DIGITS)
_NEXT_GROUP = re.compile(rf"[ \t](?:[-/][ \t])?({_DIGITS})")
#: of the sieve: 8 MB in all
BITS = 26
#: words counted in a task before their counts are handed on
HELD = 1 << 18


@dataclass(frozen=True)
class Settings:
    """A pattern is two words before (side 0), two words after (1) or one word before an instance (2), in lower case.

    rounds: of scoring. trust: the score that a pattern needs; meets: how many different seeds a pattern must have met.
    Patterns are stored under the hash of their words, their context; all that met enough seeds are kept.
    most_digits: of a run of digit groups behind one pattern; no kind has more than the 19 of a card.
    """

    meets: int = 3
    rounds: int = 3
    trust: float = 0.8
    most_digits: int = 19


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, end) in code points, by kind and begin; matches that fail their test are dropped."""
    out, done = [], 0
    for m in _HOST.finditer(text) if "@" in text else ():
        begin = m.start()
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < m.start():
            out.append((0, begin, done := m.end()))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _last_words(text: str, end: int) -> list[str]:
    """The words that end before `end`, the last two of them whole however long they are."""
    size = 80
    while len(words := text[max(0, end - size) : end].split()) < 3 and size < end:
        size *= 4
    return words


def _first_words(text: str, begin: int) -> list[str]:
    """The words from `begin` on, the first two of them whole."""
    size = 80
    while len(words := text[begin : begin + size].split()) < 3 and begin + size < len(text):
        size *= 4
    return words


def _context(text: str, begin: int, end: int, right: bool = True) -> Iterator[tuple[int, str]]:
    """The patterns around a span and the punctuation at it; none across the edge of the text."""
    while begin and text[begin - 1] in _PUNCTUATION:
        begin -= 1
    if begin and text[begin - 1] in _GAP and (before := _last_words(text, begin)):
        yield 2, before[-1].lower()
        if len(before) > 1:
            yield 0, " ".join(before[-2:]).lower()
    while right and end < len(text) and text[end] in _PUNCTUATION:
        end += 1
    if right and end < len(text) and text[end] in _GAP and len(after := _first_words(text, end)) > 1:
        yield 1, " ".join(after[:2]).lower()


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a spelled out or bracketed at or dot: the name before the at may be a plain word."""
    done = 0
    for m in _SPELLED.finditer(text):
        begin = m.start()
        while True:
            while begin > done and text[begin - 1] not in _EDGE:
                begin -= 1
            joint = _DOT_BEFORE.search(text, max(done, begin - 8), begin)
            if not joint or joint.start() == done or text[joint.start() - 1] in _EDGE:
                break
            begin = joint.start()
        while begin < m.start() and text[begin] in _PUNCTUATION:
            begin += 1
        # a number or another identifier at a host is no name
        open_at = m[0][1:3].lower() == "at" and m[0][0] in _GAP and not _DOT_WORD.search(m[0])
        name = text[begin : m.start()]
        if name and not (open_at and (not any(c.isalpha() for c in name) or any(c in "@#/\\" for c in name))):
            done = m.end()
            yield begin, done


def _groups(text: str, begin: int, end: int, limit: int) -> list[tuple[int, int]]:
    """The groups of digits that begin with the word and go on behind it, up to `limit`; none if the word is no group."""
    first = begin - (begin > 0 and text[begin - 1] == "(")
    m = _GROUP.match(text, first) or _GROUP.match(text, begin)
    if not m or m.end() < end:
        return []
    run = [m.span()]
    while (m := _NEXT_GROUP.match(text, run[-1][1])) and m.end() <= limit:
        run.append(m.span(1))
    return run if len(run) > 1 or run[0][1] == end else [(begin, end)]


def _identifiers(text: str, taken: list[tuple[int, int]], most_digits: int) -> Iterator[tuple[int, int, bool]]:
    """What looks like an identifier outside the taken spans, and whether what follows is its context.

    Words with a digit, or with a sign inside that prose has not, without punctuation at their ends; spelled addresses;
    and groups of digits with those that follow, up to `most_digits`, from each group on, as a pattern may point at any.
    """
    begins, ends = [b for b, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(begin: int, end: int) -> bool:
        before = bisect_left(begins, end)
        return not before or ends[before - 1] <= begin

    spelled = [span for span in _spelled(text) if free(*span)] if _AT.search(text) else []
    done = at = 0
    for m in _SIGN.finditer(text):
        while at < len(spelled) and spelled[at][0] <= m.start():
            yield *spelled[at], True
            done, at = max(done, spelled[at][1]), at + 1
        if m.start() < done:
            continue
        begin, end = m.start(), m.end()
        while begin > done and text[begin - 1] not in _GAP:
            begin -= 1
        while end < len(text) and text[end] not in _GAP:
            end += 1
        if at < len(spelled) and spelled[at][0] < end:
            continue
        done = end
        while begin < end and text[begin] in _PUNCTUATION:
            begin += 1
        while end > begin and text[end - 1] in _PUNCTUATION:
            end -= 1
        stop = bisect_left(begins, end)
        limit = min(begins[stop] if stop < len(begins) else len(text), spelled[at][0] if at < len(spelled) else len(text))
        if run := _groups(text, begin, end, limit):
            digits = list(accumulate((sum(c.isdigit() for c in text[b:e]) for b, e in run), initial=0))
            j = last = 0
            for i, (b, _) in enumerate(run):
                j = max(j, i)
                while j + 1 < len(run) and digits[j + 2] - digits[i] <= most_digits:
                    j += 1
                if free(b, run[j][1]):
                    yield b, run[j][1], run[j][1] > last
                last = run[j][1]
            done = max(done, last)
        elif free(begin, end) and (any(c.isdigit() for c in text[begin:end]) or _SIGN.search(text, begin + 1, end - 1)):
            yield begin, end, True
    for begin, end in spelled[at:]:
        yield begin, end, True


def _hashes(contexts: list[str]) -> np.ndarray:
    """64 bits for each text of one or two words."""
    if not contexts:
        return np.zeros(0, np.uint64)
    flat, of = word_hashes(*text_bytes(pa.array(contexts, pa.large_string())), SAME)
    out = flat[of[:-1]]
    two = np.flatnonzero(np.diff(of) > 1)
    out[two] = shingles(flat, 2)[of[two]]
    return out


def _occurrences(texts: list[str]) -> np.ndarray:
    """The hashes of all words and of all pairs of words within a text."""
    lowered = pa.array([" ".join(t.lower().split()) for t in texts], pa.large_string())
    ones, of = word_hashes(*text_bytes(lowered), SAME)
    across = np.unique(of[1:-1]) - 1
    return np.concatenate([ones, np.delete(shingles(ones, 2), across[(across >= 0) & (across < len(ones) - 1)])])


def seeds(rows: DataFrame) -> DataFrame:
    """kind, side, context, instance: which base spans stand in which pattern, without repetitions within a piece."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = set()
            for text in piece.column("text").to_pylist():
                for kind, begin, end in base_spans(text):
                    found.update((kind, side, words, text[begin:end]) for side, words in _context(text, begin, end))
            if found:
                kinds, sides, words, instances = map(list, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(sides, pa.int64()), pa.array(_hashes(words).view(np.int64)), pa.array(instances)], ["kind", "side", "context", "instance"])

    return rows.mapInArrow(find, "kind long, side long, context long, instance string")


def patterns_of(found: DataFrame, s: Settings) -> DataFrame:
    """kind, side, context of all patterns that met enough different seeds, however rare they are."""
    met = found.groupBy("kind", "side", "context").agg(F.countDistinct("instance").alias("met"))
    return met.where(F.col("met") >= s.meets).select("kind", "side", "context")


def sieve(patterns: DataFrame) -> np.ndarray:
    """A bit for each value of the first BITS bits of a context, whether a pattern has it: of the same size for any number.

    It spares tasks from asking about contexts that are no pattern. What passes is joined with the table, which decides.
    """
    bit = F.shiftrightunsigned("context", 64 - BITS)
    parts = patterns.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(1 << BITS - 3, np.uint8)
    for row in parts.toLocalIterator():
        out[row.part << 12 : row.part + 1 << 12] = np.frombuffer(row.bits, np.uint8)
    return out


def _passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    bit = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _candidates(texts: list[str], base: list[list[tuple[int, int, int]]], bits: np.ndarray, most_digits: int) -> Iterator[tuple[int, int | None, int, int, int, int]]:
    """(text, kind, side, context, begin, end) of base spans and, without a kind, of identifiers outside them, if the context passes."""
    found, contexts = [], []
    for i, (text, own) in enumerate(zip(texts, base, strict=True)):
        spans = [(kind, begin, end, True) for kind, begin, end in own]
        spans += ((None, *found_at) for found_at in _identifiers(text, sorted((b, e) for _, b, e in own), most_digits))
        for kind, begin, end, right in spans:
            for side, words in _context(text, begin, end, right):
                found.append((i, kind, side, begin, end))
                contexts.append(words)
    hashes = _hashes(contexts)
    for j in np.flatnonzero(_passing(hashes, bits)).tolist():
        i, kind, side, begin, end = found[j]
        yield i, kind, side, int(hashes[j : j + 1].view(np.int64)[0]), begin, end


def _names(instances: list[str]) -> np.ndarray:
    """64 bits for each instance."""
    return _hashes(["".join("\0" if c.isspace() else c for c in x) for x in instances])


def admitted_seeds(rows: DataFrame, admitted: DataFrame, s: Settings) -> DataFrame:
    """What `seeds` gives for base spans, for all occurrences of the admitted instances (kind, instance)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _names(batch.column("instance").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["context"])

    bits = sieve(admitted.select("instance").mapInArrow(name, "context long"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            spans = []
            for text in piece.column("text").to_pylist():
                taken = sorted((b, e) for _, b, e in base_spans(text))
                spans += ((text, *found) for found in _identifiers(text, taken, s.most_digits))
            passing = _passing(_names([text[b:e] for text, b, e, _ in spans]), bits) if spans else []
            found = {(side, words, text[b:e]) for (text, b, e, right), ok in zip(spans, passing, strict=True) if ok for side, words in _context(text, b, e, right)}
            if found:
                sides, words, instances = map(list, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(sides, pa.int64()), pa.array(_hashes(words).view(np.int64)), pa.array(instances)], ["side", "context", "instance"])

    around = rows.mapInArrow(find, "side long, context long, instance string")
    return around.join(admitted, "instance").select("kind", "side", "context", "instance")


def edges(rows: DataFrame, patterns: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """kind, side, context, instance, known, n: all identifiers that stand in the patterns, known or not; and the patterns
    with `whole`, how often their words occur at all.
    """
    bits = sieve(patterns)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def everywhere() -> pa.RecordBatch:
            words = np.concatenate([w for w, _ in held])
            order = np.argsort(words, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(words[order]) != 0]))
            n = np.add.reduceat(np.concatenate([n for _, n in held])[order], first)
            none = pa.nulls(len(first), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(words[order][first].view(np.int64)), pa.nulls(len(first), pa.string()), pa.array(n)], names)

        for piece in pieces(batches):
            texts = piece.column("text").to_pylist()
            words = _occurrences(texts)
            held.append(np.unique(words[_passing(words, bits)], return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                yield everywhere()
                held, size = [], 0
            found = Counter((kind, side, context, texts[i][begin:end]) for i, kind, side, context, begin, end in _candidates(texts, [base_spans(t) for t in texts], bits, s.most_digits))
            if found:
                own, side, context, instance = map(list, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(side, pa.int64()), pa.array(context, pa.int64()), pa.array(instance, pa.string()), pa.array(list(found.values()), pa.int64())], names)
        if size:
            yield everywhere()

    names = ["own", "side", "context", "instance", "n"]
    marks = stored(rows.mapInArrow(find, "own long, side long, context long, instance string, n long"))
    words = marks.where("side is null").groupBy("context").agg(F.sum("n").alias("anywhere"))
    met = stored(marks.where("side is not null").groupBy("own", "side", "context", "instance").agg(F.sum("n").alias("n")))
    graph = stored(met.join(patterns, ["side", "context"]).where("own is null or own = kind").select("kind", "side", "context", "instance", F.col("own").isNotNull().alias("known"), "n"))
    # not below what it meets
    least = graph.groupBy("kind", "side", "context").agg(F.sum("n").alias("least"))
    whole = patterns.join(words, "context", "left").join(least, ["kind", "side", "context"])
    return graph, stored(whole.select("kind", "side", "context", F.greatest("least", "anywhere").alias("whole")))


def scored(graph: DataFrame, patterns: DataFrame, s: Settings) -> DataFrame:
    """kind, side, context, score after the rounds.

    An instance that is a base span has trust 1, any other one minus the product, over its patterns, of one minus their
    score. A pattern's score is the mean trust over all its occurrences, 0 where they meet none. Rounds begin with trust 0.
    """
    keys = ["kind", "side", "context"]

    def scores(of: DataFrame) -> DataFrame:
        good = of.groupBy(*keys).agg(F.sum(F.col("trust") * F.col("n")).alias("good"))
        return patterns.join(good, keys).select(*keys, (F.col("good") / F.col("whole")).alias("score"))

    of = graph.withColumn("trust", F.col("known").cast("double"))
    for _ in range(s.rounds):
        again = graph.join(scores(of), keys)
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        trust = again.groupBy("kind", "instance").agg((1 - doubt).alias("trust"))
        given = F.when(F.col("known"), 1.0).otherwise(F.col("trust"))
        of = stored(again.join(trust, ["kind", "instance"]).withColumn("trust", given).drop("score"))
    return scores(of)


def learned(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """kind, side, context of the trusted patterns, learned from all documents: a stored table, of any number.

    What trusted patterns find is admitted: its occurrences seed further patterns, those are scored along with the first
    ones, and so on until no pattern is added. A corpus whose patterns find nothing unseen is read once and no more.
    """
    keys = ["kind", "side", "context"]
    rows = docs.select(whole_text().alias("text"))
    found = stored(seeds(rows))
    patterns = stored(patterns_of(found, s))
    while not patterns.isEmpty():
        graph, whole = edges(rows, patterns, s)
        trusted = stored(scored(graph, whole, s).where(F.col("score") >= s.trust).select(*keys))
        admitted = stored(graph.where("not known").join(trusted, keys).select("kind", "instance").distinct())
        if admitted.isEmpty():
            return trusted
        found = stored(found.unionByName(admitted_seeds(rows, admitted, s)).distinct())
        grown = stored(patterns_of(found, s).unionByName(patterns).distinct())
        if grown.join(patterns, keys, "left_anti").isEmpty():
            return trusted
        patterns = grown
    return patterns


def found_spans(docs: DataFrame, patterns: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, base, more: arrays of (kind, begin, end, text) by kind and begin; `more` are what patterns find beyond the base.

    Null texts are empty and have no span; repeated rows have the same; an identifier read as several kinds gets the
    first. What follows or precedes a trusted pattern and looks like an identifier is a span of its kind.
    Rows ask about the contexts of their identifiers, and the join with the patterns answers. A very long text is searched
    whole, with what it asks in one row; an empty table gives no rows.
    """
    bits = sieve(patterns)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = piece.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            asks = [[] for _ in texts]
            for i, kind, side, context, begin, end in _candidates(texts, base, bits, s.most_digits):
                if kind is None:
                    asks[i].append(dict(side=side, context=context, begin=begin, end=end, text=texts[i][begin:end]))
            spans = [[dict(kind=KINDS[k], begin=b, end=e, text=t[b:e]) for k, b, e in own] for t, own in zip(texts, base, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(spans, of_base), pa.array(asks, of_asks)], ["doc_id", "base", "asks"])

    place = [("begin", pa.int64()), ("end", pa.int64()), ("text", pa.string())]
    of_base = pa.list_(pa.struct([("kind", pa.string()), *place]))
    of_asks = pa.list_(pa.struct([("side", pa.int64()), ("context", pa.int64()), *place]))
    span = "array<struct<kind: string, begin: bigint, end: bigint, text: string>>"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    rows = rows.mapInArrow(find, f"doc_id long, base {span}, asks array<struct<side: bigint, context: bigint, begin: bigint, end: bigint, text: string>>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    asks = rows.select("row", F.explode("asks").alias("ask")).select("row", "ask.*")
    told = asks.join(patterns, ["side", "context"]).groupBy("row", "begin", "end", "text").agg(F.min("kind").alias("kind"))
    # of groups of digits that a pattern points at, the longest run
    longest = F.max("end").over(Window.partitionBy("row").orderBy("begin", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("before", longest).where("before is null or before < end")
    more = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "begin", "end", "text"))).alias("more"))
    named = F.transform("more", lambda x: F.struct(F.get(F.array(*map(F.lit, KINDS)), x["kind"].cast("int")).alias("kind"), x["begin"].alias("begin"), x["end"].alias("end"), x["text"].alias("text")))
    return rows.join(more, "row", "left").select("doc_id", "base", F.coalesce(named, F.array().cast(span)).alias("more"))


def personal_data(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, base, more for every row, with patterns learned from the same documents."""
    return found_spans(docs, learned(docs, s), s)
