"""Toxicity by a noisy channel: decode disguised words under a character language model, then score the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, pieces, released, small_batches, texts, written
from .shingles import mixed, shingle_hashes

#: The letters that a sign may stand for.
LEET = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "*": "aeiou",
    "#": "aeiou",
    "%": "aeiou",
}
#: Channel costs (negative log probabilities): a sign for a letter, a sign with a sure letter left out, another sign left
#: out, a repeat left out, a letter said once that is written twice, a gap left out, a gap kept where words are parted.
SIGN, LOSE, DROP, REPEAT, TWICE, GAP, KEEP = 1.0, 9.0, 3.0, 0.5, 1.5, 0.3, 1.5
#: Orders of hashes. Texts of a label that share the least one under three of them are near copies, which count as one.
SKETCHES = 4
#: Units that a text without copies counts. Sums of whole numbers are the same in any order.
ONE = 1 << 20
#: Words kept in a worker's memory with their weights.
CACHE = 250_000
#: Bits of the tables that keep rows from a join which finds nothing for them; of this size whatever the input.
BITS = 1 << 24
#: Bits and bytes of one of Spark's bitmaps.
BUCKET = 1 << 15
#: Stands in letter pairs for all letters beyond the Latin ones, so that no more pairs are there than a worker can hold.
LATIN, OTHER = "\u024f", "\ufffd"

_WORD = re.compile(r"[^\W\d_]+")
_SAME = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1+")
_FOREIGN = re.compile(rf"[^\0-{LATIN}]")
_TAIL = re.compile(r"([^\w\s])\1\1+\W*$")
_GAPS = r"[\s.\-_*]+"
_SPACED = re.compile(rf"(?<!\S)(?:\S{_GAPS}){{3,}}\S(?!\S)")
_EDGE = ".,;:?\"'()[]{}<>"
#: What is left of a text's bytes when gaps and signs go and signs that stand for letters become the first of these.
_FIRST = bytes(ord(LEET[chr(i)][0]) if chr(i) in LEET else i for i in range(256))
_GONE = bytes(i for i in range(128) if not chr(i).isalpha() and chr(i) not in LEET)


@dataclass
class ToxicityModel:
    """Word and word-start weights (log-likelihood ratios), letter-pair costs, and the offset of the sum of weights."""

    weights: dict[str, float]
    pairs: dict[str, float]
    unseen: float
    offset: float
    known: dict[str, float] = field(default_factory=dict, repr=False)
    restore: bool = True

    def words_in(self, letters: str) -> set[str]:
        """The words with a weight that a text without gaps holds anywhere."""
        if not hasattr(self, "machine"):
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for word in self.weights:
                if word[0] != "^" and len(word) > 2:
                    self.machine.add_word(word, word)
            self.machine.make_automaton()
        return {word for _, word in self.machine.iter(letters)} if len(self.machine) else set()

    def starts(self) -> set[str]:
        """The first four letters of all word starts with a weight."""
        if not hasattr(self, "begun"):
            self.begun = {f[1:5] for f in self.weights if f[0] == "^"}
        return self.begun

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("machine", "begun")} | {"known": {}}


def forms(word: str) -> tuple[str, ...]:
    """A word's features: itself, and its first 4 to 6 letters."""
    n = len(word)
    return (word, *("^" + word[:k] for k in (4, 5, 6) if k <= n))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per place of the token, what may have been meant there and what the channel charges for it. A gap, white space or
    signs that part letters, is a gap between words or nothing."""
    out, i = [], 0
    while i < len(token):
        c, run = token[i], 1
        while i + run < len(token) and token[i + run] == c:
            run += 1
        if c.isalpha():
            out.append([(c, 0.0)] if run == 1 else [(c, TWICE if run == 2 else REPEAT), (c * 2, 0.0 if run == 2 else 2 * REPEAT)])
        elif c.isspace():
            out.append([(" ", KEEP), ("", GAP)])
        else:
            letters = [(x, SIGN) for x in LEET.get(c, "")]
            for _ in range(min(run, 2)):
                out.append([*letters, ("", (DROP if c in "*#%" else LOSE) if letters else 0.1)])
        i += run
    return out


def latin(word: str) -> str:
    return word if word.isascii() else _FOREIGN.sub(OTHER, word)


def squeezed(low: str) -> str:
    """The text without gaps and signs; signs that stand for letters are the first of these."""
    raw = low.replace("€", LEET["€"]).encode("utf-8", "surrogatepass")
    return raw.translate(_FIRST, _GONE).decode("utf-8", "surrogatepass")


def restored(token: str, model: ToxicityModel) -> str:
    """The likeliest spelling: Viterbi over the lattice, states being the last letter, costs from letter pairs. What was
    said is kept as a chain of what came before it, so a place costs the same in a long token as in a short one."""
    pairs, unseen = model.pairs, model.unseen
    if token.isalpha():  # all paths have the same states, so each letter that is repeated is settled by itself
        return _RUN.sub(lambda m: m[0] if len(m[0]) == 2 and pairs.get(latin(m[0]), unseen) < TWICE else m[1], token)
    best: dict[str, tuple[float, tuple | None]] = {"^": (0.0, None)}
    for place in lattice(token):
        after: dict[str, tuple[float, tuple | None]] = {}
        for last, (cost, said) in best.items():
            for letters, charge in place:
                total, state = cost + charge, last
                for x in letters:
                    if x == " ":
                        total += pairs.get(state + "$", unseen) if state != "^" else 0.0
                        state = "^"
                    else:
                        after_it = x if x <= LATIN else OTHER
                        total += pairs.get(state + after_it, unseen)
                        state = after_it
                if state not in after or total < after[state][0]:
                    after[state] = (total, (said, letters) if letters else said)
        best = after
    said = min((cost + (pairs.get(last + "$", unseen) if last != "^" else 0.0), last) for last, (cost, _) in best.items())[1]
    out, at = [], best[said][1]
    while at is not None:
        at, letters = at
        out.append(letters)
    return "".join(reversed(out))


def readings(token: str, model: ToxicityModel) -> set[str]:
    """The words that a token, lower-cased, may be read as: as written, and restored. Only a token with a sign or a letter
    twice in a row has more than one path through its lattice; of any length."""
    core = token.strip(_EDGE)
    words = {core} if core.isalpha() else set(_WORD.findall(token))
    if model.restore and len(core) > 2 and (_SAME.search(core) or not core.isalpha()):
        said = restored(_TAIL.sub("", core), model)
        words.update(_WORD.findall(said))
        words.add(_RUN.sub(r"\1", said))
    return words


def word_weight(word: str, model: ToxicityModel) -> float:
    get = model.weights.get
    if word[:4] not in model.starts():
        return get(word, 0.0)
    return max(get(f, 0.0) for f in forms(word))


def token_weight(token: str, model: ToxicityModel) -> float:
    core = token.strip(_EDGE)
    if core.isalpha() and not _SAME.search(core):  # one reading
        return word_weight(core, model)
    return math.fsum(word_weight(w, model) for w in readings(token, model))


def parted(low: str, model: ToxicityModel) -> set[str]:
    """Words that gaps part, as Viterbi reads them: those of runs of single signs, and those with a weight that the text
    holds, from a gap to a gap, once its gaps are left out."""
    found: set[str] = set()
    for run in _SPACED.finditer(low):
        found.update(_RUN.sub(r"\1", w) for w in _WORD.findall(restored(re.sub(_GAPS, " ", run.group()), model)))
    for word in model.words_in(squeezed(low)):
        signs = ["".join(re.escape(k) for k, v in LEET.items() if c in v) for c in word]
        spelt = rf"(?:{_GAPS})?".join(f"[{c}{more}]" for c, more in zip(word, signs, strict=True))
        for run in re.finditer(rf"(?<![^\W_]){spelt}(?![^\W_])", low):
            if re.search(_GAPS, run.group()) and word in _WORD.findall(restored(re.sub(_GAPS, " ", run.group()), model)):
                found.add(word)
    return found


def evidence(text: str, model: ToxicityModel) -> float:
    """The weights of all distinct tokens of the whole text, and of words parted by gaps."""
    low = text.lower()
    tokens, known = set(low.split()), model.known
    new = tokens.difference(known)
    if len(known) + len(new) > CACHE:
        known.clear()
        new = tokens
    for token in new:
        known[token] = token_weight(token, model)
    total = math.fsum(map(known.__getitem__, tokens))
    if model.restore:
        total += math.fsum(word_weight(w, model) for w in parted(low, model) - tokens)
    return total


def score_text(text: str, model: ToxicityModel) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, evidence(text, model) + model.offset))))


def letter_pairs(counts: Counter) -> tuple[dict[str, float], float]:
    """Add-one costs of a letter after another; ^ and $ stand for a word's start and end."""
    after: Counter = Counter()
    for pair, n in counts.items():
        after[pair[0]] += n
    alphabet = len({p[1] for p in counts}) + 1
    return {p: -math.log((n + 1) / (after[p[0]] + alphabet)) for p, n in counts.items()}, math.log(sum(after.values()) + alphabet)


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, same) with the least of each text's hashes of three words, under SKETCHES orders; near copies share most."""
    for part in pieces(batches):
        hashes, first = shingle_hashes(part.column("text"), 3)
        out = np.zeros((SKETCHES, part.num_rows), np.uint64)
        some = np.flatnonzero(np.diff(first))
        for i in range(SKETCHES):
            if len(some):
                out[i, some] = np.minimum.reduceat(mixed(hashes ^ mixed(np.array([i + 1], np.uint64))), first[:-1][some])
        columns = [part.column("doc_id"), part.column("same"), *(pa.array(h.view(np.int64)) for h in out)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "same", *(f"h{i}" for i in range(SKETCHES))])


def bitmaps(keys: DataFrame, key: Column) -> DataFrame:
    """Rows of a bucket and its bits: set where a key, a number from 0, falls modulo BITS; 2 MB at most."""
    at = F.pmod(key, F.lit(BITS)) + 1
    return keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def maybe_in(rows: DataFrame, maps: DataFrame, key: Column) -> DataFrame:
    """The rows of `rows` whose key's bit is set: all whose key is there, and some others."""
    at = F.pmod(key, F.lit(BITS)).alias("at")
    near = rows.select("*", at).join(F.broadcast(maps), F.expr(f"at div {BUCKET} + 1") == F.col("bucket"))
    byte = F.expr(f"cast(conv(hex(substring(bits, cast(at % {BUCKET} div 8 as int) + 1, 1)), 16, 10) as int)")
    return near.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0).select(*rows.columns)


def labelled_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(text, mark, units) of every text with a mark, written once; `units` are ONE over the number of its near copies.

    Ids and sketches meet before texts do, and rows without a mark, but for a share that a table of bits cannot tell, are
    left out before either; a text moves once.
    """
    hashed = F.xxhash64("doc_id")
    docs = maybe_in(docs, bitmaps(marks, hashed), hashed).withColumn("same", F.xxhash64("text"))
    hs = [f"h{i}" for i in range(SKETCHES)]
    rows = docs.select("doc_id", "same", "text").mapInArrow(released(sketched), f"doc_id long, same long, {', '.join(f'{h} long' for h in hs)}")
    rows = rows.groupBy("doc_id", "same").agg(F.count(F.lit(1)).alias("n"), *(F.first(h).alias(h) for h in hs))
    rows = written(rows.join(marks.hint("merge"), "doc_id"), "toxic-sketches")
    # A group's size goes to its rows in 16 parts, as one group may hold most rows.
    part = F.pmod(F.xxhash64("doc_id", "same"), F.lit(16)).cast("int").alias("part")
    least = rows.select("doc_id", "same", "mark", "n", part, F.posexplode(F.array(*hs)).alias("i", "h"))
    sizes = least.groupBy("mark", "i", "h").agg(F.sum("n").alias("size")).where("size > 1")
    sizes = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    own = least.join(sizes.hint("merge"), ["mark", "i", "h", "part"]).groupBy("doc_id", "same").agg(
        *(F.max(F.when(F.col("i") == i, F.col("size"))).alias(f"s{i}") for i in range(SKETCHES))
    )
    copies = F.sort_array(F.array(*(F.coalesce(f"s{i}", F.lit(1)) for i in range(SKETCHES))))[1]
    units = F.greatest(F.expr("1L"), F.floor(F.lit(ONE) / copies))
    marks = rows.select("doc_id", "same", "mark").join(own.hint("merge"), ["doc_id", "same"], "left").select("doc_id", "same", "mark", units.alias("units"))
    every = written(docs.join(marks.hint("merge"), ["doc_id", "same"]).select("text", "mark", "units"), "toxic-texts")
    discard(rows)
    return every


def counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, n): per letter pair the units of the texts' distinct words, as written, that it is in, once for each place."""
    size = ord(LATIN) + 2  # the last stands for OTHER
    total = np.zeros(size * size, np.int64)
    for part in pieces(batches):
        own = [set(_WORD.findall(text.lower())) for text in part.column("text").to_pylist()]
        units = np.repeat(part.column("units").to_numpy(), [len(words) for words in own])
        letters = "".join(f"^{word}$" for words in own for word in words).encode("utf-32-le")
        at = np.minimum(np.frombuffer(letters, np.uint32).astype(np.int64), size - 1)
        word = np.cumsum(at == ord("^")) - 1
        inside = np.flatnonzero(at[:-1] != ord("$"))
        np.add.at(total, at[inside] * size + at[inside + 1], units[word[inside]])
    cells = np.flatnonzero(total)
    names = ["".join(OTHER if x == size - 1 else chr(x) for x in divmod(int(c), size)) for c in cells]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total[cells])], ["f", "n"])


def counted_features(batches: Iterator[pa.RecordBatch], model: ToxicityModel, bits: bytes | None) -> Iterator[pa.RecordBatch]:
    """(f, n): per feature the units of the texts that have it; with `bits`, of features whose bit is set."""
    seen: dict[int, Counter] = defaultdict(Counter)
    known: dict[str, tuple[str, ...]] = {}

    def rows() -> pa.RecordBatch:
        total: Counter = Counter()
        for units, counts in seen.items():
            for f, n in counts.items():
                total[f] += n * units
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["f", "n"])

    for part in pieces(batches):
        for text, units in zip(part.column("text").to_pylist(), part.column("units").to_pylist(), strict=True):
            seen[units].update(present(text, model, known, bits))
        if sum(map(len, seen.values())) > CACHE:
            yield rows()
    yield rows()


def summed(texts_of: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    return texts_of.mapInArrow(released(run), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def present(text: str, model: ToxicityModel, known: dict[str, tuple[str, ...]], bits: bytes | None) -> set[str]:
    """The features of a text; with `bits`, those whose bit is set."""

    def told(words: set[str]) -> tuple[str, ...]:
        out = [f for w in words for f in forms(w)]
        if bits is not None:
            at = [crc32(f.encode()) % BITS for f in out]
            out = [f for f, i in zip(out, at, strict=True) if bits[i >> 3] >> (i & 7) & 1]
        return tuple(out)

    low = text.lower()
    tokens = set(low.split())
    new = tokens.difference(known)
    if len(known) + len(new) > CACHE // (10 if bits is None else 2):
        known.clear()
        new = tokens
    for token in new:
        known[token] = told(readings(token, model))
    return set(told(parted(low, model))).union(*filter(None, map(known.__getitem__, tokens)))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_features: int = 50_000,
    surprise: float = 12.0,
) -> ToxicityModel:
    """Learn from every text with a label; near copies with one label count as one text, each an equal share of it.

    Costs of letter pairs come from these texts' words as written; then words are restored under them before they are
    counted. A feature counts once per text. It enters the model if its texts are toxic so much more often than chance that
    n * divergence exceeds `surprise`; its weight is the log-likelihood ratio with half a count added. Clean texts count
    only features that toxic ones have often enough to enter. At most max_features, those of most surprise, go to the
    driver; the bar that tells toxic from clean comes from the evidence of all texts. Labels that are null or of no
    document don't count; of several labels of an id the highest holds.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    marks = marks.agg((F.max(label_col).cast("int") != 0).cast("int").alias("mark"))
    every = labelled_texts(texts(docs, id_col, text_col), marks)

    pairs, unseen = letter_pairs(Counter({r["f"]: r["n"] / ONE for r in summed(every, counted_pairs).collect()}))
    plain = ToxicityModel({}, pairs, unseen, 0.0)
    sizes = {r["mark"]: r["n"] / ONE for r in every.groupBy("mark").agg(F.sum("units").alias("n")).collect()}
    bad, good = sizes.get(1, 0.0), sizes.get(0, 0.0)
    if not bad or not good:  # one class only: nothing is told apart
        discard(every)
        return ToxicityModel({}, pairs, unseen, -4.0 if not bad else 4.0)

    p = bad / (bad + good)

    def told(counts: DataFrame) -> DataFrame:
        n = F.col("bad") + F.col("good")
        q = F.col("bad") / n
        gain = F.col("bad") * F.log(q / p) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - q) / (1 - p))).otherwise(0.0)
        ratio = F.log((F.col("bad") + 0.5) / (bad + 1) / ((F.col("good") + 0.5) / (good + 1)))
        return counts.where(F.col("bad") >= 3).select("f", "bad", "good", gain.alias("gain"), ratio.alias("ratio")).where((F.col("gain") > surprise) & (F.col("ratio") > 2.5))

    def with_clean(counts: DataFrame, rows: DataFrame) -> DataFrame:
        """counts, with the clean texts among `rows` added."""
        bits = bytearray(BITS // 8)
        for r in bitmaps(counts, F.crc32(F.col("f").cast("binary"))).collect():
            at = (r["bucket"] - 1) * BUCKET // 8
            bits[at : at + len(r["bits"])] = r["bits"]
        more = summed(rows.where("mark = 0"), partial(counted_features, model=plain, bits=bytes(bits))).withColumnRenamed("n", "more")
        more = counts.join(more.hint("merge"), "f", "left")
        return more.select("f", "bad", (F.col("good") + F.coalesce(F.col("more") / ONE, F.lit(0.0))).alias("good"))

    # A clean text more only lowers gain and ratio, so what isn't told by a part of the clean texts isn't by all of them.
    counts = summed(every.where("mark = 1"), partial(counted_features, model=plain, bits=None))
    counts = counts.select("f", (F.col("n") / ONE).alias("bad"), F.lit(0.0).alias("good"))
    first = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    kept = [every]
    for name, rows in (("toxic-features", every.where(first)), ("toxic-told", every.where(~first))):
        kept.append(written(told(counts).select("f", "bad", "good"), name))
        counts = with_clean(kept[-1], rows)
    weights = {r["f"]: r["ratio"] for r in told(counts).orderBy(F.desc("gain"), "f").limit(max_features).collect()}
    model = ToxicityModel(weights, pairs, unseen, 0.0)
    bars = [b / 2 for b in range(4, 17)]

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many bars texts of each mark reach, in units."""
        seen: Counter = Counter()
        for part in pieces(batches):
            for text, mark, units in zip(*(part.column(c).to_pylist() for c in ("text", "mark", "units")), strict=True):
                z = evidence(text, model)
                seen[mark, sum(b <= z for b in bars)] += units
        columns = [pa.array([k[i] for k in seen], pa.int32()) for i in range(2)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], ["mark", "bars", "n"])

    drawn = every.mapInArrow(released(reached), "mark int, bars int, n long").groupBy("mark", "bars").agg(F.sum("n").alias("n")).collect()
    discard(*kept)
    # The bar that catches most, where a clean text caught counts as two toxic ones missed.
    caught = [sum(r["n"] * (1 if r["mark"] else -2) for r in drawn if r["bars"] > i) for i in range(len(bars))]
    model.offset = -bars[caught.index(max(caught))]
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, score (0 to 1) and predicted (1 where score >= 0.5), one row per row of df.

    Only the text decides, all of it. Null and empty texts have no evidence, so the score of the offset alone. Repeated
    rows get equal scores; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            scores = [score_text(t, model) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return texts(df, id_col, text_col).mapInArrow(released(run), "doc_id long, score double, predicted int")


def keep_civil(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose score is below 0.5; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text_col):
            yield part.filter(pa.array([t is None or score_text(t, model) < 0.5 for t in part.column(text_col).to_pylist()], pa.bool_()))

    return small_batches(df).mapInArrow(released(run), df.schema)
