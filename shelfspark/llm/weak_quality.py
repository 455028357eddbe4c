"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Their votes are counted by pattern over the whole
corpus, and expectation-maximisation on those counts estimates each labeller's accuracy in both classes and the posterior of
each pattern. The posteriors label a bounded sample of documents, on which a linear scorer over hashed word and shape
features is trained; it decides for all documents. Counts of abusive words and the posterior of the abuse labellers are features of
their own, so they count however rare abuse is. Abusive words and stems of each language are learned from a bounded sample
of labels. A labeller that votes nothing says nothing: it takes no part in the estimate of that document.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A general list of English insults.
INSULTS = tuple("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown clowns imbecile retard bastard bitch asshole fool ugly filthy vermin".split())
#: The labellers of junk and those of abuse; each group has its own latent class.
JUNK_LABELLERS = ("doubled symbols", "shouting", "stutter", "separators", "symbols", "vocabulary")
ABUSE_LABELLERS = ("an insult", "two insults", "insults by length", "learned words by rate", "two learned words", "many learned words")
DIM = 1 << 18
#: Expected documents in the training sample, chosen by a hash of id and text, and the share of them that must hold a word.
SAMPLE_DOCS = 8_000
LEAST_SHARE = 0.0125
#: Expected labelled documents from which abusive words are learned; documents voted abusive that the training sample holds at least.
LABEL_DOCS = 20_000
#: Characters of the stems that may be learned; how many times as frequent in toxic texts a learned word or stem must be.
STEMS = range(3, 9)
LEAST_RATIO = 20
LEAST_ABUSIVE = 1_000
_ABUSE, _LEXICAL = 256, 512  # first places of the abuse measures and of the words; before them stand the measures and the byte shares
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _bytes_in(values: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(values))


_SYMBOL, _SPACE = _bytes_in(b"#$%&*+<=>@[\\]^_`{|}~!?"), _bytes_in(b" \t\n\v\f\r")
_UPPER, _LETTER = _bytes_in(bytes(range(65, 91))), _bytes_in(bytes([*range(65, 91), *range(97, 123)]))
_NOISE = _bytes_in(b"#$%&*+<=>@[\\]^_`{|}~")
_INSULT_HASHES = np.array(sorted(xxhash.xxh64_intdigest(w.encode()) for w in INSULTS), np.uint64)


class Lexicon:
    """Learned stems, and whole words written with a space behind them.

    ``toxic`` and ``clean`` are their shares of the words of toxic and of clean texts.
    """

    def __init__(self, entries: tuple[bytes, ...], toxic: float, clean: float):
        self.entries, self.toxic, self.clean = frozenset(entries), toxic, clean
        # without entries that begin with another one, so that a word is found by one entry at most
        self.sought = tuple(b" " + e for e in sorted(self.entries) if not any(e[:k] in self.entries for k in range(len(e))))

    def odds(self, hits: int, n: int) -> float:
        """Log of how much likelier so many hits in n words are in a toxic text than in a clean one."""
        return hits * math.log(self.toxic / self.clean) - n * (self.toxic - self.clean)

    def hits(self, words: list[bytes]) -> int:
        """How many of the words are learned or begin with a learned stem."""
        line = b" %b " % b"  ".join(words)  # a space before and one behind each word
        return sum(map(line.count, self.sought))


def plain_words(text: str | None) -> list[bytes]:
    """Words without ASCII punctuation, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER, _PUNCTUATION).split()


class Profile:
    """What labellers and scorer look at in one text, measured on its bytes and word hashes.

    ``learned`` are abusive words and stems by language; without any for ``lang`` their labellers vote nothing.
    """

    def __init__(self, text: str | None, lang: str | None = None, learned: dict[str, Lexicon] | None = None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        words = plain_words(text)
        self.n = n = len(words)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        self.distinct = np.unique(hashes)
        self.bytes = np.bincount(data, minlength=256) / max(1, len(data))
        symbol, space = _SYMBOL[data], _SPACE[data]
        edge = np.concatenate([[True], space, [True]])
        pieces = max(1, int((edge[:-1] & ~edge[1:]).sum()))
        self.doubled = float((symbol[1:] & (data[1:] == data[:-1])).sum()) / pieces
        self.shouting = float(self.bytes[_UPPER].sum() / max(1e-9, self.bytes[_LETTER].sum()))
        self.stutter = float((hashes[1:] == hashes[:-1]).sum()) / max(1, n)
        self.separators = float((symbol & edge[:-2] & edge[2:]).sum()) / pieces
        self.symbols = float(self.bytes[_NOISE].sum())
        self.vocabulary = len(self.distinct) / max(1, n)
        self.insults = int((_INSULT_HASHES[np.searchsorted(_INSULT_HASHES[:-1], hashes)] == hashes).sum())
        self.foreign = lang is not None and not lang.lower().startswith("en")
        known = (learned or {}).get(lang or "")
        self.learned = None if known is None else known.hits(words)
        self.odds = known.odds(self.learned, n) if self.learned else -math.inf

    def votes(self) -> tuple[int, ...]:
        """1 good, -1 bad, 0 nothing: junk labellers, then abuse labellers. Texts under five words get no junk votes."""
        short = self.n < 5
        vote = lambda x, good, bad: 0 if short else -1 if x > bad else 1 if x < good else 0
        junk = (
            vote(self.doubled, 0.02, 0.15), vote(self.shouting, 0.3, 0.6), vote(self.stutter, 0.03, 0.15), vote(self.separators, 0.03, 0.15),
            vote(self.symbols, 0.01, 0.06), 0 if self.n < 30 else -1 if self.vocabulary < 0.15 else 1 if self.vocabulary > 0.4 else 0,
        )
        none = 0 if self.foreign else 1  # that a German text holds no English insult says nothing
        abuse = (-1 if self.insults else none, -1 if self.insults > 1 else none, -1 if self.insults > 0.003 * self.n else none)
        hits = self.learned
        abuse += (0, 0, 0) if hits is None else (-1 if self.odds > 2 else 1, -1 if hits > 1 else 1, -1 if self.odds > 4 else 1)  # toxic texts are the fewer
        return junk + abuse

    def features(self, abuse: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features: a bias, the measures, the shares of bytes under 128, the abuse measures with the posterior ``abuse``, and the words by presence."""
        measures = [1.0, self.doubled, self.shouting, 3 * self.stutter, self.separators, 5 * self.symbols, 1 - self.vocabulary, 1.0 if self.n < 8 else 0.0]
        used = np.flatnonzero(self.bytes[:128])
        lexical = (self.distinct % np.uint64(DIM - _LEXICAL)).astype(np.int64) + _LEXICAL
        learned = self.learned or 0
        abusive = [abuse, float(self.insults > 0), math.log1p(self.insults), min(1.0, 20 * self.insults / max(1, self.n)), float(self.odds > 2), math.log1p(learned), min(1.0, 20 * learned / max(1, self.n))]
        index = np.concatenate([np.arange(len(measures)), 8 + used, _ABUSE + np.arange(len(abusive)), lexical])
        return index, np.concatenate([measures, self.bytes[used], abusive, np.full(len(lexical), 0.5)]).astype(np.float32)


def fit_labellers(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """EM over counts of vote patterns -> posterior of "bad" per pattern, and P(bad vote or good vote | class) of each labeller.

    Starts from "any bad vote is bad"; a labeller that votes nothing takes no part; one pseudo-count a cell keeps
    probabilities away from zero.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, np.zeros((0, 2, 2))
    votes_, n = np.array(keys), np.array([patterns[k] for k in keys], float)
    bad = np.where((votes_ == -1).any(axis=1), 0.95, 0.05)
    for _ in range(rounds):
        weight = np.stack([n * (1 - bad), n * bad])
        prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        table = np.stack([[[w[votes_[:, k] == v].sum() + 1 for v in (-1, 1)] for w in weight] for k in range(votes_.shape[1])])
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(prior)[None, :] + np.zeros((len(keys), 2))
        for k in range(votes_.shape[1]):
            logs += np.where(votes_[:, k, None] == 0, 0.0, np.log(table[k])[:, (votes_[:, k] > 0).astype(int)].T)
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        done, bad = np.abs(new - bad).max() < 1e-9, new
        if done:
            break
    return dict(zip(keys, bad.tolist(), strict=True)), table


def abuse_posterior(patterns: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """P(abuse) of the abuse labellers' votes."""
    counts: Counter = Counter()
    for votes, n in patterns.items():
        counts[votes[len(JUNK_LABELLERS) :]] += n
    return fit_labellers(counts)[0]


def pattern_posterior(patterns: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """P(junk or abuse) of each vote pattern, the two groups of labellers fitted apart."""
    k, parts = len(JUNK_LABELLERS), []
    for side in (slice(None, k), slice(k, None)):
        counts: Counter = Counter()
        for votes, n in patterns.items():
            counts[votes[side]] += n
        parts.append(fit_labellers(counts)[0])
    return {v: 1 - (1 - parts[0][v[:k]]) * (1 - parts[1][v[k:]]) for v in patterns}


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 30, rate: float = 0.5, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression on soft labels by adaptive gradient steps, in the order given; rare words keep weight zero."""
    held = np.bincount(np.concatenate([i for i, _, _ in rows]), minlength=DIM) if rows else np.zeros(DIM)
    known = (held >= max(3, LEAST_SHARE * len(rows))) | (np.arange(DIM) < _LEXICAL)
    rows = [(i[known[i]], v[known[i]], b) for i, v, b in rows]
    w, seen = np.zeros(DIM), np.full(DIM, 1e-3)
    for _ in range(epochs):
        for index, value, bad in rows:
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[index] @ value))))) - bad
            step = error * value + decay * w[index]
            seen[index] += step * step
            w[index] -= rate * step / np.sqrt(seen[index])
    return w.astype(np.float32)


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.cast("string").alias("lang"))


def evidence(t: int, c: int, toxic: int, clean: int) -> float:
    """n KL of t toxic and c clean documents; the chance of so many toxic ones among them is at most exp(-n KL)."""
    n, p, base = t + c, t / max(1, t + c), toxic / max(1, toxic + clean)
    if t < 3 or p <= base:
        return 0.0
    return n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0))


def gain(wt: float, wc: float, toxic: float, clean: float) -> float:
    """Log-likelihood that a word gains by having a rate of its own in toxic texts: wt and wc uses in so many words."""
    pooled = (wt + wc) / (toxic + clean)
    return sum(n * math.log(n / (size * pooled)) for n, size in ((wt, toxic), (wc, clean)) if n)


def abusive_words(counts: dict[bytes, tuple[int, int]], holders: list[dict[bytes, int]], docs: tuple[int, int], words: tuple[int, int], least: float) -> tuple[bytes, ...]:
    """Words and stems that tell toxic documents: the one whose uses gain most first, the longest on ties, then those that tell the documents left.

    ``counts`` has clean documents and uses by word, ``holders`` the uses of words in each toxic one; ``docs`` and ``words``
    are the sizes of the toxic and the clean side. The evidence in documents must pass ``least``. Documents that are near
    copies of each other are told by one word, so their other words are not learned.
    """
    kept, open_ = [], list(holders)
    while open_:
        held, uses = Counter(w for own in open_ for w in own), Counter()
        for own in open_:
            uses.update(own)
        sure = [w for w, t in held.items() if evidence(t, counts[w][0], *docs) > least]
        if not sure:
            break
        best = max(sure, key=lambda w: (round(gain(uses[w], counts[w][1], *words), 6), len(w), w))
        kept.append(best)
        open_ = [own for own in open_ if best not in own]
    return tuple(kept)


def _tried(text: str | None) -> Counter:
    """How often each word of a text (with a space behind) and each stem stands in it."""
    out: Counter = Counter()
    for word, n in Counter(plain_words(text)).items():
        shown = word.decode("utf-8", "ignore")
        for k in STEMS:
            if len(shown) >= k:
                out[shown[:k].encode()] += n
        out[shown.encode() + b" "] += n
    return out


def learn_words(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, Lexicon]:
    """Abusive words and stems by language, from about LABEL_DOCS of the ``labels`` (doc_id, toxic), chosen by a hash of the id.

    Equal texts of a language count once. A word is tried if its share of the words of toxic texts is LEAST_RATIO times that
    of clean ones; its evidence must be beyond what chance gives any word tried in one of 20 corpora. A language without
    toxic or clean labels has no entry.
    """
    if labels is None:
        return {}
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, LABEL_DOCS / max(1, marked.count()))
    picked = marked.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)) < share)
    texts = _rows(docs, id_col, text_col, lang_col).join(F.broadcast(picked), "doc_id")  # twelve bytes a label
    texts = cut(texts.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "text").agg(F.max("toxic").alias("toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = defaultdict(lambda: [0, 0, 0, 0])
            for lang, text, toxic in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = _tried(text)
                own[b""] = sum(n for w, n in own.items() if w.endswith(b" "))  # the empty word counts documents and words
                for word, n in own.items():
                    row = seen[lang, word]
                    row[1 - toxic] += 1
                    row[3 - toxic] += n
            keys, values = list(seen), list(zip(*seen.values(), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), *(pa.array(v, pa.int64()) for v in values)], names=["lang", "word", "t", "c", "wt", "wc"]
            )

    found = texts.mapInArrow(run, "lang string, word binary, t long, c long, wt long, wc long").groupBy("lang", "word").agg(*[F.sum(k).alias(k) for k in ("t", "c", "wt", "wc")])
    found = cut(found.where("t > 0"))  # without a toxic document none is tried
    empty = F.length("word") == 0
    whole = found.where(empty & (F.col("c") > 0)).select("lang", *[F.col(k).alias(f"all_{k}") for k in ("t", "c", "wt", "wc")])
    tried = found.where(~empty).groupBy("lang").agg(F.count("*").alias("n"))
    totals = {r["lang"]: r for r in whole.join(tried, "lang").collect()}
    near = found.where(~empty & (F.col("t") >= 3)).join(F.broadcast(whole), "lang").where(f"wt * (all_wc + 1.0) > {LEAST_RATIO} * (wc + 1.0) * all_wt")
    held: dict = defaultdict(dict)
    for r in near.select("lang", "word", "t", "c", "wt", "wc").collect():  # bounded by the words of the sampled labels
        all_ = totals[r["lang"]]
        if evidence(r["t"], r["c"], all_["all_t"], all_["all_c"]) > math.log(20 * (all_["n"] + 1)):
            held[r["lang"]][bytes(r["word"])] = (r["c"], r["wt"], r["wc"])
    if not held:
        return {}
    names = {lang: frozenset(words) for lang, words in held.items()}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [{w: n for w, n in _tried(text).items() if w in names.get(lang, ())} for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = [pa.array([list(x) for x in own], pa.list_(pa.binary())), pa.array([list(x.values()) for x in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["lang", "words", "uses"])

    holders: dict = defaultdict(list)
    for r in texts.where("toxic = 1").select("lang", "text").mapInArrow(told, "lang string, words array<binary>, uses array<long>").where("size(words) > 0").toArrow().to_pylist():
        holders[r["lang"]].append(dict(zip(r["words"], r["uses"], strict=True)))  # the toxic documents of the sample
    out = {}
    for lang, words in held.items():
        all_ = totals[lang]
        kept = abusive_words({w: (c, wc) for w, (c, _, wc) in words.items()}, holders[lang], (all_["all_t"], all_["all_c"]), (all_["all_wt"], all_["all_wc"]), math.log(20 * (all_["n"] + 1)))
        if kept:
            rates = [(sum(words[w][k] for w in kept) + 1) / (all_[name] + 1) for k, name in ((1, "all_wt"), (2, "all_wc"))]
            out[lang] = Lexicon(kept, max(rates[0], 2 * rates[1]), rates[1])
    return out


def vote_patterns(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", learned: dict[str, Lexicon] | None = None) -> dict[tuple[int, ...], int]:
    """Counts of vote patterns over all documents: at most 3**12 rows, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(Profile(t, lang, learned).votes() for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, k)) for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    found = _rows(docs, id_col, text_col, lang_col).select("text", "lang").mapInArrow(run, "pattern string, n long")
    return {tuple(map(int, r["pattern"].split(","))): r["n"] for r in found.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


class Model:
    """Weights of the scorer, posteriors by votes, and the learned words."""

    def __init__(self, posterior: dict, abuse: dict, learned: dict[str, Lexicon]):
        self.posterior, self.abuse, self.learned = posterior, abuse, learned
        self.weights = np.zeros(DIM, np.float32)

    def look(self, text: str | None, lang: str | None) -> tuple[tuple[int, ...], float, Profile]:
        """Votes, P(abuse) and profile of a text."""
        profile = Profile(text, lang, self.learned)
        votes = profile.votes()
        return votes, self.abuse.get(votes[len(JUNK_LABELLERS) :], 0.0), profile

    def logit(self, profile: Profile, abuse: float) -> float:
        index, value = profile.features(abuse)
        return float(self.weights[index] @ value)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, labels: DataFrame | None = None, lang_col: str = "lang") -> Model:
    learned = learn_words(docs, labels, id_col, text_col, lang_col)
    patterns = vote_patterns(docs, text_col, id_col, lang_col, learned)
    model = Model(pattern_posterior(patterns), abuse_posterior(patterns), learned)
    share = min(1.0, sample_docs / max(1, sum(patterns.values())))
    abusive = sum(n for v, n in patterns.items() if model.abuse[v[len(JUNK_LABELLERS) :]] > 0.5)
    abusive_share = min(1.0, max(share, LEAST_ABUSIVE / max(1, abusive))) if abusive else share
    place = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)).alias("place")
    picked = _rows(docs, id_col, text_col, lang_col).select("doc_id", "text", "lang", place).where((F.col("place") < abusive_share) | F.lit(abusive_share >= 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, value, bad = [], [], [], []
            for doc_id, text, lang, place in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                votes, abuse, profile = model.look(text, lang)
                if place < share or abuse > 0.5:
                    i, v = profile.features(abuse)
                    ids.append(doc_id)
                    index.append(i.tolist())
                    value.append(v.tolist())
                    bad.append(model.posterior.get(votes, 0.5))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), pa.array(bad, pa.float64())], names=["doc_id", "i", "v", "bad"])

    sample = picked.mapInArrow(run, "doc_id long, i array<int>, v array<float>, bad double").toArrow().combine_chunks()
    rows = []
    if len(sample):
        lists = [sample.column(k).chunk(0) for k in (1, 2)]
        ends, (index, value) = lists[0].offsets.to_pylist(), [x.values.to_numpy(zero_copy_only=False) for x in lists]
        rows = [(index[a:b], value[a:b], bad) for a, b, bad in zip(ends, ends[1:], sample.column(3).to_pylist(), strict=False)]
        ids = sample.column(0).to_pylist()
        order = sorted(range(len(rows)), key=lambda k: (ids[k] is None, xxhash.xxh64_intdigest(str(ids[k])), len(rows[k][0]), rows[k][2]))
        rows = [rows[k] for k in order]
    model.weights = train(rows)
    return model


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, labels: DataFrame | None = None, lang_col: str = "lang") -> DataFrame:
    """``(doc_id, votes, posterior, score, keep)`` per row of docs: score is the scorer's probability of "bad"; keep is score <= 0.5.

    NULL and empty texts have no votes but on the insults (none) and are scored by the bias and the empty vocabulary; very
    long texts are measured whole; repeated rows get equal scores, and a score of 0.5 is kept; an empty table gives no rows; other columns are ignored. ``labels`` (doc_id, toxic) and
    the language, if there is one, give the abusive words of each language.
    """
    model = fit(docs, id_col, text_col, sample_docs, labels, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown, post, score = [], [], []
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own, abuse, profile = model.look(text, lang)
                shown.append(",".join(map(str, own)))
                post.append(round(model.posterior.get(own, 0.5), 6))
                score.append(round(1 / (1 + math.exp(-max(-30.0, min(30.0, model.logit(profile, abuse))))), 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string()), pa.array(post, pa.float64()), pa.array(score, pa.float64()), pa.array([s <= 0.5 for s in score], pa.bool_())], names=["doc_id", "votes", "posterior", "score", "keep"])

    return _rows(docs, id_col, text_col, lang_col).mapInArrow(run, "doc_id long, votes string, posterior double, score double, keep boolean")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, labels: DataFrame | None = None, lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the scorer keeps, with all their columns."""
    model = fit(docs, id_col, text_col, sample_docs, labels, lang_col)

    def score(texts: pd.Series, langs: pd.Series) -> pd.Series:
        looks = (model.look(t, lang) for t, lang in zip(texts, langs, strict=True))
        return pd.Series([model.logit(profile, abuse) <= 0 for _, abuse, profile in looks], dtype="bool")

    good = F.pandas_udf(score, "boolean")
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    return docs.where(good(F.col(text_col).cast("string"), lang.cast("string")))
