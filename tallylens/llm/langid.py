"""Language identification by unigram pieces, marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word (with the mark of a
word's beginning) scores the sum over all its segmentations into pieces of the product of their
probabilities, by a forward recursion; a text scores the product over its words and the language's share.
Characters that no piece covers count as one rare piece. Probabilities are fitted by expectation
maximisation on a bounded sample of labelled documents, whose words are counted by the tasks that read
them; prediction sees the text alone. Words are lower-cased runs between Unicode white space, found by
Arrow's kernels for learning and prediction alike.

Defined cases: null text and text without a letter give `und` with score 0; null lang is no label; with
no labelled document at all every text is `und`; equal scores go to the language first by code point; null
and repeated doc_ids are no hindrance: a row without one is not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow_batches, lean, materialize

MARK = "▁"
#: Longest piece that is looked up, in characters.
LONGEST = 16
#: Words up to this length are scored and learned from in plain numbers, longer ones in logarithms, and
#: those above LONG by stretches side by side. Learning cuts words into stretches of at most LEARNED.
SHORT, LONG, LEARNED = 24, 256, 4096
#: Characters of a very long word looked up together.
STRIP = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Scores of words kept in memory; when there are more, the memory starts anew.
LIMIT = 300_000


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of the public vocabulary, without control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return sorted({p for p in pieces if len(p) <= LONGEST})


def _prefix_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes of the rows of codes, and powers of the base."""
    n, width = codes.shape
    h = np.zeros((n, width + 1), dtype="uint64")
    for k in range(width):
        h[:, k + 1] = h[:, k] * _BASE + codes[:, k]
    return h, np.concatenate([np.ones(1, dtype="uint64"), np.cumprod(np.full(LONGEST, _BASE))])


class Lattice:
    """Finds the pieces in words: piece[e, l - 1, w] is the number of word w's piece that ends before
    place e and has l characters; `none` where there is none."""

    def __init__(self, pieces: list[str]):
        hashes = np.array([self._hash(p) for p in pieces], dtype="uint64")
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype("int32")
        assert len(np.unique(hashes)) == len(pieces)
        self.unknown, self.none = len(pieces), len(pieces) + 1

    @staticmethod
    def _hash(p: str) -> np.uint64:
        codes = np.frombuffer(p.encode("utf-32-le"), dtype="<u4").astype("uint64") + np.uint64(1)
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in codes:
                h = h * _BASE + c
        return h

    def find(self, words: list[str], width: int) -> np.ndarray:
        """words: all of `width` characters."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), width).astype("uint64") + np.uint64(1)
        h, power = _prefix_hashes(codes)
        out = np.full((width + 1, min(width, LONGEST), len(words)), self.none, dtype="int32")
        last = len(self.hashes) - 1
        for n in range(1, min(width, LONGEST) + 1):
            sub = h[:, n:] - h[:, :-n] * power[n]
            at = np.minimum(np.searchsorted(self.hashes, sub), last)
            hit = self.hashes[at] == sub
            out[n:, n - 1, :] = np.where(hit, self.numbers[at], self.unknown if n == 1 else self.none).T
        return out


def forward(found: np.ndarray, logp: np.ndarray, in_logs: bool) -> np.ndarray:
    """Log of the sum over all segmentations, for each word and language. logp: piece x language, the
    last row is that of no piece (minus infinity)."""
    places, lengths, n = found.shape
    width = places - 1
    if in_logs:
        a = np.full((places, n, logp.shape[1]), -np.inf)
        a[0] = 0
        for e in range(1, places):
            for k in range(1, min(e, lengths) + 1):
                ids = found[e, k - 1]
                who = np.flatnonzero(ids != len(logp) - 1)
                if len(who):
                    a[e, who] = np.logaddexp(a[e, who], a[e - k, who] + logp[ids[who]])
        return a[width]
    p = np.exp(logp)
    a = np.zeros((places, n, logp.shape[1]))
    a[0] = 1
    for e in range(1, places):
        for k in range(1, min(e, lengths) + 1):
            ids = found[e, k - 1]
            who = np.flatnonzero(ids != len(logp) - 1)
            if len(who):
                a[e, who] += a[e - k, who] * p[ids[who]]
    return np.log(a[width])


def _transfer(pieces: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How the sums at a stretch's last LONGEST places follow from those before it, for all stretches at once.

    pieces: stretch x place x length. Gives m[j, stretch, s, language], the sum j places before the end if
    the one s places before the beginning were 1 and the others 0, and the logs of what m is divided by."""
    n, width, longest = pieces.shape
    ring = np.zeros((longest, n, longest, p.shape[1]))
    ring[np.arange(longest), :, np.arange(longest)] = 1
    scale, head = np.zeros(ring.shape[1:]), 0
    for e in range(width):
        now = np.zeros(ring.shape[1:])
        for k in range(longest):
            now += ring[(head + k) % longest] * p[pieces[:, e, k]][:, None]
        head = (head - 1) % longest
        ring[head] = now
        if e % 8 == 7 or e == width - 1:
            top = ring.max(0)
            top[top == 0] = 1
            ring /= top
            scale += np.log(top)
    scale[ring.max(0) == 0] = -np.inf  # no piece reaches that far back
    return np.roll(ring, -head, axis=0), scale


def forward_long(lattice: Lattice, word: str, logp: np.ndarray) -> np.ndarray:
    """As forward() of one word, which may be very long: stretches of it are worked on side by side, and the
    memory is that of STRIP characters."""
    p, langs = np.exp(logp), logp.shape[1]
    state, total = np.zeros((LONGEST, langs)), np.zeros(langs)
    state[0] = 1
    for at in range(0, len(word), STRIP):
        lead = min(at, LONGEST - 1)
        part = word[at - lead : at + STRIP]
        found = lattice.find([part], len(part))[lead + 1 :, :, 0]
        found = np.pad(found, ((0, 0), (0, LONGEST - found.shape[1])), constant_values=lattice.none)
        width = max(1, int(np.sqrt(len(found))))
        full = len(found) // width * width
        for stretches in (found[:full].reshape(-1, width, LONGEST), found[full:][None]):
            if not stretches.size:
                continue
            m, scale = _transfer(stretches, p)
            for k in range(len(stretches)):
                w = np.where(state > 0, scale[k], -np.inf)
                top = w.max(0)
                state = np.einsum("jsl,sl->jl", m[:, k], state * np.exp(w - top))
                norm = state.max(0)
                state, total = state / norm, total + top + np.log(norm)
    return total + np.log(state[0])


def words_of(texts: pa.Array) -> pa.ListArray:
    """The lower-cased words of each text, without the mark of a word's beginning."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))


class Scorer:
    """Scores words and texts under every language."""

    def __init__(self, pieces: list[str], logp: np.ndarray, limit: int = LIMIT):
        self.lattice, self.limit = Lattice(pieces), limit
        self.logp = np.vstack([logp, np.full((1, logp.shape[1]), -np.inf)])
        self.clear()

    def clear(self) -> None:
        self.names = pa.array([], pa.string())
        self.table = np.zeros((0, self.logp.shape[1]))

    def words(self, words: list[str], batch: int = 4096) -> np.ndarray:
        """Log scores of words, which carry the mark already."""
        out = np.zeros((len(words), self.logp.shape[1]))
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for width, who in by.items():
            if width > LONG:
                for k in who:
                    out[k] = forward_long(self.lattice, words[k], self.logp)
                continue
            step = batch if width <= SHORT else max(1, batch // width)
            for a in range(0, len(who), step):
                part = who[a : a + step]
                found = self.lattice.find([words[k] for k in part], width)
                out[part] = forward(found, self.logp, width > SHORT)
        return out

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Log scores of whole texts that have a word: the sums over their words."""
        if len(self.names) > self.limit:
            self.clear()
        lists = words_of(texts)
        words = lists.flatten()
        number = pc.index_in(words, value_set=self.names)
        if number.null_count:
            new = words.filter(number.is_null()).unique()
            self.table = np.vstack([self.table, self.words([MARK + w for w in new.to_pylist()])])
            self.names = pa.concat_arrays([self.names, new])
            number = pc.index_in(words, value_set=self.names)
        offsets = lists.offsets.to_numpy()
        return np.add.reduceat(self.table[number.to_numpy()], offsets[:-1] - offsets[0])


def _expected_long(lattice: Lattice, counts: dict[str, int], words: list[str], p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words of any lengths, in logarithms. Words are padded to the longest."""
    sizes = np.array([len(w) for w in words])
    width, n = int(sizes.max()), len(words)
    found = lattice.find([w.ljust(width, "\0") for w in words], width)
    found = np.where(np.arange(width + 1)[:, None, None] > sizes, lattice.none, found)
    with np.errstate(divide="ignore"):
        logp = np.log(p)
    a, b = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
    a[0] = b[sizes, np.arange(n)] = 0
    for e in range(1, width + 1):
        k = np.arange(1, min(e, LONGEST) + 1)
        a[e] = np.logaddexp.reduce(a[e - k] + logp[found[e, k - 1]], axis=0)
    for s in range(width - 1, -1, -1):
        k = np.arange(1, min(width - s, LONGEST) + 1)
        b[s] = np.logaddexp(b[s], np.logaddexp.reduce(b[s + k] + logp[found[s + k, k - 1]], axis=0))
    seen, rest = np.zeros(len(p)), np.log([counts[w] for w in words]) - a[sizes, np.arange(n)]
    for k in range(1, min(width, LONGEST) + 1):
        ids = found[k:, k - 1]
        seen += np.bincount(ids.ravel(), np.exp(a[:-k] + logp[ids] + b[k:] + rest).ravel(), len(p))
    return seen


def _stretches(counts: dict[str, int]) -> dict[str, int]:
    """The counts with words longer than LEARNED cut into consecutive stretches."""
    out: dict[str, int] = {}
    for w, n in counts.items():
        for a in range(0, len(w), LEARNED):
            out[w[a : a + LEARNED]] = out.get(w[a : a + LEARNED], 0) + n
    return out


def _batches(words: list[str], chars: int = 1 << 17) -> list[list[str]]:
    """Words of like lengths together, so many that little more than `chars` characters are padded."""
    out: list[list[str]] = []
    for w in sorted(words, key=lambda w: (len(w), w)):
        if not out or len(w) > 2 * len(out[-1][0]) or len(w) * (len(out[-1]) + 1) > chars:
            out.append([])
        out[-1].append(w)
    return out


def fit_language(lattice: Lattice, counts: dict[str, int], rounds: int = 4, smooth: float = 0.05) -> np.ndarray:
    """Log probabilities of all pieces and the unknown one, by expectation maximisation over the words."""
    size = lattice.unknown + 1
    counts = _stretches(counts)
    by: dict[int, list[str]] = {}
    for w in counts:
        if len(w) <= SHORT:
            by.setdefault(len(w), []).append(w)
    long = _batches([w for w in counts if len(w) > SHORT])
    p = np.append(np.full(size, 1 / size), 0.0)
    for _ in range(rounds):
        seen = np.zeros(size + 1)
        for width, words in by.items():
            for at in range(0, len(words), 8192):
                part = words[at : at + 8192]
                weight = np.array([counts[w] for w in part], dtype="float64")
                found = lattice.find(part, width)
                a, b = np.zeros((width + 1, len(part))), np.zeros((width + 1, len(part)))
                a[0] = b[width] = 1
                for e in range(1, width + 1):
                    for k in range(1, min(e, LONGEST) + 1):
                        a[e] += a[e - k] * p[found[e, k - 1]]
                for s in range(width - 1, -1, -1):
                    for k in range(1, min(width - s, LONGEST) + 1):
                        b[s] += b[s + k] * p[found[s + k, k - 1]]
                scale = weight / np.maximum(a[width], 1e-300)
                for e in range(1, width + 1):
                    for k in range(1, min(e, LONGEST) + 1):
                        ids = found[e, k - 1]
                        seen += np.bincount(ids, a[e - k] * p[ids] * b[e] * scale, size + 1)
        for part in long:
            seen += _expected_long(lattice, counts, part, p)
        seen[-1] = 0
        p = (seen + smooth) / (seen.sum() + smooth * size)
        p[-1] = 0
    return np.log(p[:size])


def held_out(doc_id):
    """The documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def _word_counts(sample: DataFrame) -> DataFrame:
    """lang, word, n of sample(lang, text): the distinct words of a bounded sample."""
    in_arrow_batches(sample.sparkSession, 500)

    def run(batches):
        for b in batches:
            lists = words_of(b.column("text"))
            t = pa.table({"lang": b.column("lang").take(pc.list_parent_indices(lists)), "word": lists.flatten()})
            t = t.group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from t.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).to_batches()

    by = sample.select("lang", "text").mapInArrow(lean(run), "lang string, word string, n long")
    return by.where("word != ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _bounded(words: DataFrame, langs: int, most_words: int, most_chars: int) -> DataFrame:
    """Each language's most frequent words: its share of most_words and of most_chars. Ranked before the shuffle."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.length("word"), "word")
    few = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, most_words // langs))
    return few.withColumn("chars", F.sum(F.length("word")).over(order)).where(F.col("chars") <= max(1, most_chars // langs)).select("lang", "word", "n")


def fit(docs: DataFrame, *, docs_per_language: int = 400, most_docs: int = 40_000, most_words: int = 1_600_000, most_chars: int = 1 << 25, vocabulary_path: str | None = None) -> dict:
    """Fits on docs(doc_id, text, lang) with a label that are not held out. What is learned from is bounded twice:
    about docs_per_language whole documents of each language, most_docs in all, are drawn by a hash of doc_id
    and text (copies of one document under one id, or without ids, are drawn all or none); and of their words,
    which tasks count, the most frequent go to the driver, most_words and most_chars of all languages at
    most. The shares of the languages are counted over all labelled documents."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    known = known.select("doc_id", "text", "lang")
    totals = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    langs = sorted(totals, key=lambda x: x.encode())
    if not langs:
        return {"langs": [], "pieces": [], "logp": None, "prior": None}
    per = max(1, min(docs_per_language, most_docs // len(langs)))
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, per / n)) for k, n in totals.items()], "lang string, rate double")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(61)), 11) / float(1 << 53)
    # One row for each language, as many as the totals that are here already: texts needn't be shuffled.
    sample = known.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("lang", "text")
    counts: dict = {k: {} for k in langs}
    seen = materialize(_bounded(_word_counts(sample), len(langs), most_words, most_chars), "lang-words").toArrow()
    for lang, word, n in sorted(zip(*seen.to_pydict().values(), strict=True)):
        counts[lang][MARK + word] = n
    pieces = vocabulary(vocabulary_path)
    lattice = Lattice(pieces)
    logp = np.stack([fit_language(lattice, counts[k]) for k in langs], axis=1)
    prior = np.log(np.array([totals[k] for k in langs]) / sum(totals.values()))
    return {"langs": langs, "pieces": pieces, "logp": logp, "prior": prior}


def decide(scorer: Scorer | None, model: dict, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's language, that of no language being one more, and its posterior probability."""
    none = len(model["langs"])
    lang, score = np.full(len(texts), none), np.zeros(len(texts))
    usable = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False)
    if scorer and pc.any(usable).as_py():
        x = scorer.texts(texts.filter(usable)) + model["prior"]
        x = np.exp(x - x.max(1, keepdims=True))
        who, best = usable.to_numpy(zero_copy_only=False), x.argmax(1)
        score[who] = x[np.arange(len(best)), best] / x.sum(1)
        lang[who] = best
    return lang, score


def scorer_of(model: dict) -> Scorer | None:
    return Scorer(model["pieces"], model["logp"]) if model["langs"] else None


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, lang_pred, score."""
    in_arrow_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages numbers

    def run(batches):
        scorer = scorer_of(shared.value)
        for b in batches:
            lang, score = decide(scorer, shared.value, b.column("text"))
            names = pa.array([*shared.value["langs"], "und"], pa.string()).take(pa.array(lang))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), names, pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.select("doc_id", "held_out", "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def kept_documents(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is found with a posterior of at least `least`; all columns stay."""
    in_arrow_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = scorer_of(shared.value)
        for b in batches:
            lang, score = decide(scorer, shared.value, b.column("text"))
            yield b.filter(pa.array((lang < len(shared.value["langs"])) & (score >= least)))

    return docs.mapInArrow(lean(run), docs.schema)
