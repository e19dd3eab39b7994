"""Language ID by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to ORDER with escape probabilities (method C),
frozen after training. A text's code length under a language is the exact sum of the code lengths
of its bytes, each from the longest context that the tree knows, by escapes from longer ones. Each
tree is compiled to tables of its own over the bytes that its language has: a state is the longest
known context, found by walking back through the text, and a state's row holds the costs of all
bytes, so whole texts are scored by array look-ups, one language after the other. A model's size is
the sum of its languages' tables; a language's has at most MODEL_BYTES bytes (rarest contexts are
left out beyond that), so what is broadcast is bounded by the number of languages.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import batches_of

ORDER = 3
#: Training reads at most so many labelled documents of a language, and so many bytes of them. Of a text
#: longer than PIECES * PIECE characters it reads as many pieces of PIECE characters, spread over the text.
SAMPLE_DOCS, SAMPLE_BYTES, PIECES, PIECE = 400, 1_500_000, 4, 8192
#: A language's tables in a model.
MODEL_BYTES = 8 << 20
#: Bytes of texts that are scored at once; no array of a worker grows with a batch or a text.
STEP = 1 << 18
#: A text is in none of the languages if bytes drawn at random explain it better by this many bits.
DOUBT = 64.0


class Table:
    """One language's frozen tree as arrays, over the bytes that it has; class 0 is every other byte."""

    def __init__(self, tree: dict[tuple, Counter], order: int, classes: np.ndarray, limit: int):
        own = sorted({c for counts in tree.values() for c in counts} | {c for context in tree for c in context})
        local = {c: k + 1 for k, c in enumerate(own)}
        self.n = len(own) + 1
        at = np.zeros(int(classes.max()) + 1, np.uint8 if self.n <= 256 else np.int16)
        at[own] = np.arange(1, self.n)
        self.classes = at[classes]
        # a context has a row of costs, and one of steps for each longer length; it is left out before the shorter ones it ends in
        kept = sorted(tree, key=lambda c: (-sum(tree[c].values()), len(c), c))
        size = np.cumsum([4 * self.n * (1 + order - len(c)) for c in kept])
        kept = kept[: int(np.searchsorted(size, limit, "right"))]
        known = sorted({(), *kept}, key=lambda c: (len(c), c))
        number = {c: k for k, c in enumerate(known)}
        self.cost = np.empty((len(known), self.n), np.float32)
        first = [sum(len(c) < k for c in known) for k in range(order + 2)]
        # steps[k]: from a context of k symbols to one of k + 1 by the symbol before it; shorter ones stay as they are
        self.steps = [np.repeat(np.arange(first[k + 1], dtype=np.int32)[:, None], self.n, 1) for k in range(order)]
        for c in known:
            row = self.cost[number[c]]
            if c:
                self.steps[len(c) - 1][number[c[1:]], local[c[0]]] = number[c]
                row[:] = self.cost[number[c[1:]]]
            else:
                # below order 0 every byte that the language has not seen is equally likely
                row[:] = np.log2(256.0)
            counts = tree.get(c)
            if counts:
                total, kinds = sum(counts.values()), len(counts)
                row += np.float32(np.log2((total + kinds) / kinds))
                many = np.fromiter(counts.values(), np.float64, kinds)
                row[[local[x] for x in counts]] = np.log2((total + kinds) / many)

    @property
    def bytes(self) -> int:
        return self.cost.nbytes + sum(s.nbytes for s in self.steps)

    def costs(self, data: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Bits of each byte; pos is its place in its text. What is before a text counts as class 0."""
        s = self.classes[data]
        state = np.zeros(len(data), np.int32)
        for k, step in enumerate(self.steps, 1):
            before = np.zeros_like(s)
            before[k:] = s[:-k] if len(s) > k else 0
            before[pos < k] = 0
            state = step.ravel().take(state * np.int32(self.n) + before)
        return self.cost.ravel().take(state * np.int32(self.n) + s)


class Model:
    """Frozen trees of several languages: symbol classes, and a table for each language."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, limit: int = MODEL_BYTES):
        self.langs, self.order = sorted(texts), order
        seen = sorted({b for part in texts.values() for t in part for b in set(t)})
        # class 0 is every byte that no language has seen; its cost is the same for all of them
        self.classes = np.zeros(256, np.int32)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.n = len(seen) + 1
        self.tables = [Table(self._tree(texts[lang], order), order, self.classes, limit) for lang in self.langs]

    @property
    def bytes(self) -> int:
        return sum(t.bytes for t in self.tables)

    def _tree(self, texts: list[bytes], order: int) -> dict[tuple, Counter]:
        tree: dict[tuple, Counter] = defaultdict(Counter)
        tree[()] = Counter()
        for text in texts:
            s = self.classes[np.frombuffer(text, np.uint8)].astype(np.int64)
            for k in range(order + 1):
                if len(s) <= k:
                    break
                code = np.zeros(len(s) - k, np.int64)
                for i in range(k + 1):
                    code = code * self.n + s[i : len(s) - k + i]
                for value, many in zip(*(x.tolist() for x in np.unique(code, return_counts=True)), strict=True):
                    digits = []
                    for _ in range(k + 1):
                        value, d = divmod(value, self.n)
                        digits.append(d)
                    tree[tuple(digits[:0:-1])][digits[0]] += many
        return tree

    def lengths(self, data: np.ndarray, starts: np.ndarray, skip: int = 0) -> np.ndarray:
        """Code lengths in bits, (texts, languages), of the non-empty texts that start at `starts` in data; the first `skip` bytes are context only."""
        ends = np.append(starts[1:], len(data))
        pos = np.arange(len(data), dtype=np.int32) - np.repeat(starts, ends - starts).astype(np.int32)
        out = np.empty((len(starts), len(self.tables)))
        for j, table in enumerate(self.tables):
            bits = table.costs(data, pos)
            bits[:skip] = 0
            out[:, j] = np.add.reduceat(bits, starts, dtype=np.float64)
        return out

    def decide(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language with the shortest code and its posterior probability under equal priors."""
        best = bits.argmin(1)
        with np.errstate(under="ignore"):
            share = np.exp2(np.clip(bits.min(1)[:, None] - bits, -1000, 0)).sum(1)
        return best, 1 / share


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = SAMPLE_DOCS, bytes_per_lang: int = SAMPLE_BYTES, order: int = ORDER) -> Model:
    """A model from a bounded sample of docs: about docs_per_lang documents of each language by a seeded hash of the id.

    Rows with null language or text do not count. Without any labelled text the model knows no language.
    """
    light = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in light.groupBy(lang_col).count().collect()}
    if not counts:
        return Model({})
    u = F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1_000_000))
    # a few more than are needed, so that the sample is full; then the first ones by hash
    limit = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(int(min(1.0, 1.5 * docs_per_lang / n + 20 / n) * 1_000_000))) for k, n in counts.items()])
    text, n = F.col(text_col), F.length(text_col)
    spread = F.concat_ws("\n", *[F.substr(text, F.floor(n * k / PIECES).cast("int") + 1, F.lit(PIECE)) for k in range(PIECES)])
    part = F.when(n > PIECES * PIECE, spread).otherwise(text)
    rows = light.filter(u < limit).select(F.col(lang_col).alias("lang"), F.encode(part, "utf-8").alias("t"), u.alias("u"), F.col(id_col).alias("i"))
    texts: dict[str, list[bytes]] = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r["u"], str(r["i"]), r["t"])):
        own = texts[r["lang"]]
        room = bytes_per_lang - sum(map(len, own))
        if len(own) < docs_per_lang and r["t"] and room > 0:
            own.append(bytes(r["t"][:room]))
    return Model({k: v for k, v in texts.items() if v}, order)


def _decide(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """lang_pred, score, and by how many bits the language explains the text better than bytes drawn at random do."""
    pred, score, gain = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if not model.langs:
        return pred, score, gain
    letters = pa.compute.fill_null(pa.compute.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
    step = STEP
    for lo, n, data, offsets in batches_of(texts, step):
        if len(data) > step:
            # a very long text in steps that overlap by the order
            bits = np.zeros((1, len(model.langs)))
            for at in range(0, len(data), step):
                back = min(at, model.order)
                bits += model.lengths(data[at - back : at + step], np.array([0]), back)
            use = np.zeros(1, np.int64)
        else:
            use = np.flatnonzero(np.diff(offsets))
            if not len(use):
                continue
            bits = model.lengths(data, offsets[:-1][use])
        best, p = model.decide(bits)
        size = np.diff(offsets)[use]
        for k, b, x, least, many in zip(use.tolist(), best.tolist(), p.tolist(), bits.min(1).tolist(), size.tolist(), strict=True):
            if letters[lo + k]:
                pred[lo + k], score[lo + k], gain[lo + k] = model.langs[b], x, 8.0 * many - least
    return pred, score, gain


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, _ = _decide(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def accepted(docs: DataFrame, model: Model, languages: tuple[str, ...] | None = None, least: float = 0.0, doubt: float = DOUBT, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose predicted language is one of `languages` (all that the model knows) with a score of `least` or more.

    Rejected are null and empty texts, texts without a letter, and texts in none of the languages:
    those that 8 bits a byte describe in fewer bits than the likeliest language does, by more than `doubt`.
    """
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted, at = set(model.langs if languages is None else languages), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, gain = _decide(shared.value, batch.column(at))
            yield batch.filter(pa.array(np.array([p in wanted for p in pred], bool) & (score >= least) & (gain >= -doubt)))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row of docs, from the text alone.

    lang_pred is `und` (score 0) if the text is null or has no letter, or if the model knows no
    language. score is the probability of lang_pred under equal priors; of equal code lengths the
    first language by name wins. Texts of any length are read whole, in steps. An empty table gives
    an empty result; repeated rows are scored alike. Other columns of docs are not read.
    """
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_score(shared), "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
