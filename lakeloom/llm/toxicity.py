"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Each word enters as a word vector and a character vector. Both hold a part known from the start, how much
more often toxic training texts have the word (or the strongest of its character n-grams) than clean ones,
and a learned part. Two gated recurrent layers read a window of words forwards and backwards, attention
weighs their states, and a logistic unit scores the pooled state. Training is plain numpy with Adam, in one
task, on a sample of labelled rows whose bound is a parameter; every text is scored whole, over all windows
that overlap by half, and takes the score of its worst window.

Cases: null text is the empty text; a text without words scores 0; very long texts and words are read whole; repeated
rows get equal scores, and of the texts of a repeated id one is learned from; labels that are null are not learned from, of several labels of a document the highest
counts; without labels of both kinds all scores are 0; extra columns are ignored.
"""

from __future__ import annotations

import io
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import ALNUM_WORDS, lower_bytes, pieces_of, ship

_CACHED_WORDS = 250_000
_BATCH = 2048
_SPOT_BITS = 20


@dataclass(frozen=True)
class Settings:
    """``train_each``: labelled rows of each kind that are learned from at most, none over ``train_chars``."""

    window: int = 64
    stride: int = 32
    hidden: int = 8
    learned: int = 4
    buckets: int = 4096
    train_each: int = 1500
    train_chars: int = 20_000
    lexicon: int = 20_000
    epochs: int = 8
    seed: int = 11


def grams(word: bytes) -> set[bytes]:
    """Character 3- to 6-grams of a whole word with its ends marked."""
    marked = b"<" + word + b">"
    size = len(marked)
    return {marked[i:j] for i in range(size - 2) for j in range(i + 3, min(i + 6, size) + 1)}


def _marked_chunks(words: list[bytes], size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of words with their ends marked, in chunks, and the word of each byte; pieces of a word that is
    longer than a chunk share their ends, so that every 6-gram is in one."""
    held, owners, total = [], [], 0
    for k, word in enumerate(words):
        marked = b"<" + word + b">"
        for at in range(0, max(1, len(marked) - 5), size - 5):
            piece = marked[at : at + size]
            held.append(piece)
            owners.append(k)
            total += len(piece)
            if total >= size:
                yield np.frombuffer(b"".join(held), np.uint8), np.repeat(owners, [len(p) for p in held])
                held, owners, total = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.repeat(owners, [len(p) for p in held])


def _codes(raw: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the lengths 3 to 6: the length, the grams within words as integers that no other gram has, their words."""
    code = raw.astype(np.uint64)
    for n in range(2, 7):
        code = code[:-1] << np.uint64(8) | raw[n - 1 :]
        if n > 2:
            inside = owner[n - 1 :] == owner[: max(0, len(owner) - n + 1)]
            yield n, code[inside] | np.uint64(n << 48), owner[n - 1 :][inside]


def _spots(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows_of(n: int, size: int, stride: int) -> list[tuple[int, int]]:
    """[start, end) of overlapping windows that cover n words; the last ends with the text."""
    if n <= size:
        return [(0, n)]
    starts = list(range(0, n - size, stride)) + [n - size]
    return [(s, s + size) for s in starts]


class Network:
    """Weights by name; ``words`` and ``grams`` map to known strengths."""

    def __init__(self, settings: Settings, words: dict[bytes, float], grams_: dict[bytes, float], weights: dict[str, np.ndarray] | None = None):
        self.s, self.words, self.grams = settings, words, grams_
        coded = np.array([int.from_bytes(g, "big") | len(g) << 48 for g in grams_], np.uint64)
        order = np.argsort(coded)
        self.gram_codes, self.gram_strength = coded[order], np.array(list(grams_.values()), np.float64)[order]
        self.gram_spots = np.zeros(1 << _SPOT_BITS, bool)  # where a known gram may be, so that few are searched for
        self.gram_spots[_spots(coded, _SPOT_BITS)] = True
        self.word_row = {w: k + 1 for k, w in enumerate(words)}
        self.width = 2 + 2 * settings.learned
        self.w = weights or self._fresh()
        self._cache: dict[bytes, int] = {}
        self._table: list[tuple] = []
        self._inputs: tuple | None = None
        self.slim = False  # only scores: descriptions of words go once their inputs are known

    def _fresh(self) -> dict[str, np.ndarray]:
        rng, s = np.random.default_rng(self.s.seed), self.s
        h, d = s.hidden, self.width
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        w = {"word": normal(len(self.words) + 1, s.learned, scale=0.05), "char": normal(s.buckets, s.learned, scale=0.05)}
        for side in "fb":
            w[f"x{side}"], w[f"u{side}"], w[f"c{side}"] = normal(d, 3 * h, scale=0.4), normal(h, 3 * h, scale=0.3), np.zeros(3 * h, np.float32)
        w |= {"att": normal(2 * h, h, scale=0.3), "v": normal(h, scale=0.3), "out": normal(2 * h, scale=0.3), "bias": np.zeros(1, np.float32), "fit": np.array([1, 0], np.float32)}
        return w

    # Inputs -------------------------------------------------------------------------------------

    def describe(self, words: list[bytes]) -> list[tuple[float, float, int, list[int]]]:
        """Of each word its known strength, known character strength, row of the word table, and buckets of the
        character table."""
        strength, buckets = np.zeros(len(words)), self.s.buckets
        keys = []
        for raw, owner in _marked_chunks(words):
            for n, codes, of in _codes(raw, owner):
                if n == 3:
                    keys.append(np.unique(of * buckets + _spots(codes, 32) % buckets))
                at = np.flatnonzero(self.gram_spots[_spots(codes, _SPOT_BITS)])
                if len(at):
                    found = np.minimum(np.searchsorted(self.gram_codes, codes[at]), len(self.gram_codes) - 1)
                    known = self.gram_codes[found] == codes[at]
                    np.maximum.at(strength, of[at[known]], self.gram_strength[found[known]])
        key = np.unique(np.concatenate(keys)) if len(keys) > 1 else keys[0] if keys else np.zeros(0, np.int64)
        ends = np.searchsorted(key, np.arange(len(words) + 1) * buckets).tolist()
        flat = (key % buckets).tolist()
        return [(self.words.get(w, 0.0), x, self.word_row.get(w, 0), flat[i:j]) for w, x, i, j in zip(words, strength.tolist(), ends, ends[1:])]

    def ids(self, words: list[bytes]) -> np.ndarray:
        cache = self._cache
        if fresh := sorted(set(words).difference(cache)):
            cache.update(zip(fresh, range(len(self._table), len(self._table) + len(fresh))))
            self._table.extend(self.describe(fresh))
        return np.fromiter(map(cache.__getitem__, words), np.int64, len(words))

    def forget(self) -> None:
        if len(self._cache) > _CACHED_WORDS:
            self._cache, self._table, self._inputs = {}, [], None

    def vectors(self, rows: list[tuple]) -> np.ndarray:
        out = np.zeros((len(rows), self.width), np.float32)
        if not rows:
            return out
        k = self.s.learned
        out[:, 0] = [r[0] for r in rows]
        out[:, 1] = [r[1] for r in rows]
        out[:, 2 : 2 + k] = self.w["word"][[r[2] for r in rows]]
        sizes = np.array([len(r[3]) for r in rows])
        flat = np.array([b for r in rows for b in r[3]], np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        sums = np.stack([np.bincount(owner, self.w["char"][flat, j], len(rows)) for j in range(k)], axis=1)
        out[:, 2 + k :] = sums / np.maximum(sizes, 1)[:, None]
        return out

    def _projected(self) -> tuple[np.ndarray, np.ndarray]:
        """Input parts of all gates for every word seen, kept as words are added."""
        done = self._inputs[0].shape[0] if self._inputs else 0
        if done < len(self._table):
            x = self.vectors(self._table[done:])
            if self.slim:
                self._table[done:] = [None] * (len(self._table) - done)
            new = tuple(x @ self.w[f"x{s}"] + self.w[f"c{s}"] for s in "fb")
            self._inputs = tuple(np.concatenate((a, b)) for a, b in zip(self._inputs, new)) if self._inputs else new
        return self._inputs or (np.zeros((0, 3 * self.s.hidden), np.float32),) * 2

    # Forwards -----------------------------------------------------------------------------------

    def _layer(self, parts: np.ndarray, mask: np.ndarray | None, side: str, keep: list | None) -> np.ndarray:
        """States (steps, windows, hidden) of one direction; ``parts``: (steps, windows, 3 hidden)."""
        h, u = self.s.hidden, self.w[f"u{side}"]
        steps = range(len(parts)) if side == "f" else range(len(parts) - 1, -1, -1)
        state = np.zeros((parts.shape[1], h), np.float32)
        out = np.empty((*parts.shape[:2], h), np.float32)
        for t in steps:
            part, rec = parts[t], state @ u
            gates = sigmoid(part[:, : 2 * h] + rec[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            fresh = np.tanh(part[:, 2 * h :] + r * rec[:, 2 * h :])
            new = fresh + z * (state - fresh)
            if mask is not None:
                new = np.where(mask[t][:, None], new, state)
            if keep is not None:
                keep.append((t, state, z, r, fresh, rec[:, 2 * h :]))
            state = out[t] = new
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple:
        inner = np.tanh(states @ self.w["att"])
        energy = inner @ self.w["v"]
        if mask is not None:
            energy = np.where(mask, energy, -1e9)
        weight = np.exp(energy - energy.max(axis=0))
        if mask is not None:
            weight = weight * mask
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        return inner, weight, pooled, pooled @ self.w["out"] + self.w["bias"][0]

    def logits(self, ids: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Of windows, given as columns of word ids (steps, windows)."""
        forward, backward = self._projected()
        if not len(forward):
            return np.full(ids.shape[1], self.w["bias"][0])
        states = np.concatenate((self._layer(forward[ids], mask, "f", None), self._layer(backward[ids], mask, "b", None)), axis=2)
        return self._pool(states, mask)[3]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The calibrated score of each whole text: that of its worst window."""
        s = self.s
        self.forget()
        best = np.full(len(texts), -np.inf)
        full, short = ([], []), ([], [])
        for k, text in enumerate(texts):
            ids = self.ids(ALNUM_WORDS.findall(lower_bytes(text)))
            for a, b in windows_of(len(ids), s.window, s.stride) if len(ids) else ():
                into = full if b - a == s.window else short
                into[0].append(k)
                into[1].append(ids[a:b])
        for (owners, spans), padded in ((full, False), (short, True)):
            for at in range(0, len(spans), _BATCH):
                own, held = np.array(owners[at : at + _BATCH]), spans[at : at + _BATCH]
                mask = None
                if padded:
                    longest = max(1, max(map(len, held)))
                    block, mask = np.zeros((len(held), longest), np.int64), np.zeros((len(held), longest), bool)
                    for i, ids in enumerate(held):
                        block[i, : len(ids)], mask[i, : len(ids)] = ids, True
                    mask = mask.T
                else:
                    block = np.stack(held)
                np.maximum.at(best, own, self.logits(block.T, mask))
        calibrated = sigmoid(np.where(np.isfinite(best), best, 0) * float(self.w["fit"][0]) + float(self.w["fit"][1]))
        return np.where(np.isfinite(best), calibrated, 0.0)

    # Training -----------------------------------------------------------------------------------

    def gradients(self, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray, importance: np.ndarray, drop: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over windows (steps, windows); ``drop``: words whose known word strength is hidden."""
        h, k, w = self.s.hidden, self.s.learned, self.w
        distinct, local = np.unique(ids, return_inverse=True)
        local = local.reshape(ids.shape)
        rows = [self._table[i] for i in distinct]
        base = self.vectors(rows)
        x = base[local]
        x[drop, 0] = 0
        keeps: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._layer(x @ w[f"x{s}"] + w[f"c{s}"], mask, s, keeps[s]) for s in "fb"], axis=2)
        inner, weight, pooled, logit = self._pool(states, mask)
        p = sigmoid(logit)
        loss = float(-(importance * (labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7))).sum())
        g: dict[str, np.ndarray] = {}
        d = ((p - labels) * importance).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pool = d[:, None] * w["out"]
        d_states = weight[:, :, None] * d_pool
        d_weight = (states * d_pool).sum(axis=2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", d_energy, inner)
        d_inner = d_energy[:, :, None] * w["v"] * (1 - inner**2)
        g["att"] = np.einsum("tbi,tbj->ij", states, d_inner)
        d_states = d_states + d_inner @ w["att"].T
        d_x = np.zeros_like(x)
        for n, side in enumerate("fb"):
            u = w[f"u{side}"]
            g[f"u{side}"], d_part = np.zeros_like(u), np.zeros((*ids.shape, 3 * h), np.float32)
            back = np.zeros((ids.shape[1], h), np.float32)
            for t, state, z, r, fresh, rec in reversed(keeps[side]):
                out = back + d_states[t, :, n * h : (n + 1) * h]
                live = mask[t][:, None]
                on = out * live
                d_fresh = on * (1 - z) * (1 - fresh**2)
                d_z, d_r = on * (state - fresh) * z * (1 - z), d_fresh * rec * r * (1 - r)
                d_rec = np.concatenate((d_z, d_r, d_fresh * r), axis=1)
                d_part[t] = np.concatenate((d_z, d_r, d_fresh), axis=1)
                g[f"u{side}"] += state.T @ d_rec
                back = on * z + d_rec @ u.T + out * ~live
            g[f"x{side}"] = np.einsum("tbi,tbj->ij", x, d_part)
            g[f"c{side}"] = d_part.sum(axis=(0, 1))
            d_x += d_part @ w[f"x{side}"].T
        d_word = np.zeros((len(rows), 2 * k), np.float32)
        np.add.at(d_word, local.ravel(), d_x[:, :, 2:].reshape(-1, 2 * k))
        g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
        np.add.at(g["word"], [r[2] for r in rows], d_word[:, :k])
        sizes = np.array([len(r[3]) for r in rows])
        flat = np.array([b for r in rows for b in r[3]], np.int64)
        np.add.at(g["char"], flat, np.repeat(d_word[:, k:] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
        return loss, g

    # Storage ------------------------------------------------------------------------------------

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, words=np.frombuffer(b"\n".join(self.words), np.uint8), word_strength=np.array(list(self.words.values()), np.float32), grams=np.frombuffer(b"\n".join(self.grams), np.uint8), gram_strength=np.array(list(self.grams.values()), np.float32), **{f"w_{k}": v for k, v in self.w.items()})
        return out.getvalue()

    @classmethod
    def load(cls, settings: Settings, blob: bytes) -> Network:
        held = np.load(io.BytesIO(blob))
        named = lambda n, s: dict(zip(held[n].tobytes().split(b"\n"), held[s].tolist())) if len(held[s]) else {}
        net = cls(settings, named("words", "word_strength"), named("grams", "gram_strength"), {k[2:]: held[k] for k in held.files if k.startswith("w_")})
        net.slim = True
        return net


def strengths(toxic: list[set[bytes]], clean: list[set[bytes]], most: int, parts=None) -> dict[bytes, float]:
    """Scaled log odds of features that at least three toxic texts have, the strongest ``most`` of them.

    ``parts`` gives the features of a word, by default itself. Texts are counted one at a time, and clean ones
    only for features that toxic ones have.
    """
    features = (lambda held: set().union(*map(parts, held))) if parts else (lambda held: held)
    bounds = np.zeros(1 << 22, np.uint16)  # how often at most, by hash, so that rare features are never held
    for held in toxic:
        seen = np.fromiter(map(hash, found := features(held)), np.int64, len(found))
        bounds[np.unique(seen & (len(bounds) - 1))] += 1
    t = Counter()
    for held in toxic:
        t.update(g for g in features(held) if bounds[hash(g) & (len(bounds) - 1)] >= 3)
    t = Counter({g: n for g, n in t.items() if n >= 3})
    c = Counter()
    for held in clean:
        c.update(g for g in features(held) if g in t)
    odds = lambda g: math.log((t[g] + 0.5) / (len(toxic) + 1)) - math.log((c[g] + 0.5) / (len(clean) + 1))
    found = {g: odds(g) * (1 - 1 / t[g]) for g in t}
    best = sorted((g for g in found if found[g] > 1), key=lambda g: (-found[g], g))[:most]
    return {g: found[g] / 4 for g in best}


def _families(texts: list[list[bytes]]) -> list[int]:
    """Places of texts that share neither of two least shingle hashes with an earlier one, so that copies count once."""
    seen: set[tuple[int, int]] = set()
    out = []
    for k, words in enumerate(texts):
        shingles = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        keys = {(seed, min(xxhash.xxh64_intdigest(s, seed) for s in shingles)) for seed in (1, 2, 3)}
        if not keys & seen:
            out.append(k)
        seen |= keys
    return out


def train(texts: list[str | None], labels: list[int], settings: Settings) -> Network | None:
    """A network from labelled texts; none without both kinds."""
    shared: dict[bytes, bytes] = {}  # one object for each distinct word
    words = [[shared.setdefault(w, w) for w in ALNUM_WORDS.findall(lower_bytes(t))] for t in texts]
    kept = [k for k in _families(words) if words[k]]
    words, y = [words[k] for k in kept], np.array([labels[k] for k in kept])
    if not (y == 1).any() or not (y == 0).any():
        return None
    toxic, clean = [set(words[k]) for k in np.flatnonzero(y == 1)], [set(words[k]) for k in np.flatnonzero(y == 0)]
    net = Network(settings, strengths(toxic, clean, settings.lexicon), strengths(toxic, clean, settings.lexicon, grams))
    rng = np.random.default_rng(settings.seed)

    # Windows to learn from: the strongest by known strength of each text, and two others of clean ones.
    rows, targets = [], []
    coded = [net.ids(w) for w in words]
    known = np.array([max(r[0], r[1]) for r in net._table], np.float32)
    for ids, label in zip(coded, y):
        spans = windows_of(len(ids), settings.window, settings.stride)
        worth = [float(np.sort(known[ids[a:b]])[-3:].sum()) for a, b in spans]
        order = np.argsort(worth)[::-1]
        chosen = [order[0]] if label else [order[0], *rng.choice(len(spans), min(2, len(spans)), replace=False)]
        for k in set(int(c) for c in chosen):
            rows.append(ids[slice(*spans[k])])
            targets.append(label)
    # Clean words said over and over stay clean.
    benign = np.unique(np.concatenate([ids for ids, label in zip(coded, y) if not label]))
    benign = benign[np.argsort(-known[benign], kind="stable")][:2000]
    for k in rng.permutation(len(benign))[: max(20, len(rows) // 8)]:
        rows.append(np.full(int(rng.integers(2, settings.window + 1)), benign[k]))
        targets.append(0)
    block, mask = np.zeros((len(rows), settings.window), np.int64), np.zeros((len(rows), settings.window), bool)
    for i, ids in enumerate(rows):
        block[i, : len(ids)], mask[i, : len(ids)] = ids, True
    targets = np.array(targets, np.float32)
    importance = np.where(targets == 1, 0.5 / max(1, targets.sum()), 0.5 / max(1, (1 - targets).sum())).astype(np.float32) * len(targets)

    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    size = int(min(128, max(16, len(rows) // 8)))
    step, rounds = 0, max(settings.epochs, math.ceil(300 * size / len(rows)))
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            ids, live = block[pick].T, mask[pick].T
            _, g = net.gradients(ids, live, targets[pick], importance[pick] / len(pick), rng.random(ids.shape) < 0.3)
            step += 1
            for name, grad in g.items():
                if name in ("word", "char"):
                    grad = grad + 1e-4 * net.w[name]
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad**2
                net.w[name] = net.w[name] - (0.01 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    # Calibration over whole training texts: clean ones end low, toxic ones high.
    net._inputs = None
    raw = net.scores(texts_of(words))
    logit = np.log(np.clip(raw, 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(raw, 1e-9, 1 - 1e-9))
    high, low = np.quantile(logit[y == 1], 0.05), np.quantile(logit[y == 0], 0.999)
    middle, gap = (high + low) / 2, max(high - low, 0.5)
    slope = min(8 / gap, 4.0)
    net.w["fit"] = np.array([slope, math.log(0.7 / 0.3) - slope * middle], np.float32)
    return net


def texts_of(words: list[list[bytes]]) -> list[str]:
    return [b" ".join(w).decode("utf-8", "surrogatepass") for w in words]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> bytes | None:
    """The trained network, from labelled rows that meet ``learn`` (a predicate on the id).

    The sample has at most ``2 * train_each`` ids, taken by their hash, and one text of at most ``train_chars``
    characters for each, so the broadcast of its ids and the one task that trains are bounded.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & learn).groupBy(F.col(id_col).alias("_k")).agg(F.max(label_col).alias("_y"))
    pick = lambda y: known.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(settings.train_each)
    sample = pick(1).union(pick(0))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.coalesce(F.char_length("_t"), F.lit(0)) <= settings.train_chars)
    rows = rows.join(F.broadcast(sample), F.col("_id") == F.col("_k")).select("_k", "_t", "_y", F.xxhash64("_k", "_t").alias("_h"))
    rows = rows.groupBy("_k").agg(F.min_by(F.struct("_t", "_y", "_h"), F.struct("_h", "_t")).alias("r")).select("r.*")

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((h, t or "", y) for b in batches for t, y, h in zip(*(c.to_pylist() for c in b.columns)))
        net = train([t for _, t, _ in held], [y for _, _, y in held], settings)
        yield pa.RecordBatch.from_arrays([pa.array([net.dump() if net else None], pa.binary())], ["model"])

    row = rows.repartition(1).mapInArrow(learn_all, "model binary").first()
    return None if row is None or row["model"] is None else bytes(row["model"])


def score(docs: DataFrame, model: bytes | None, settings: Settings, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, score)`` of every whole text."""
    ship(docs.sparkSession)
    if "score" in (id_col, *keep):
        raise ValueError("the column score is added here and cannot be kept")
    columns = [id_col, *(c for c in keep if c != id_col)]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.load(settings, held.value) if held.value else None
        for batch in pieces_of(batches, 256):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            values = net.scores(texts) if net else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values.astype(np.float64))], [*columns, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", score double"
    return docs.select(*columns, F.col(text_col).alias("_scored_text")).mapInArrow(run, schema)
