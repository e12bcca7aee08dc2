"""Languages named by character n-gram profiles, as Column functions of a text's words."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import values as V

# fixed values: n-gram sizes, n-grams of a profile, least words to be named, least n-grams, words of a posture, share of the second distance
SIZES, PROFILE, LEAST_WORDS, LEAST_GRAMS, FLOOR, NEARER = (2, 3, 4), 200, 6, 8, 12, 0.85


def profile(words: list[str]) -> list[str]:
    """The commonest n-grams of padded words, ties in byte order."""
    counts: dict[str, int] = {}
    for w in words:
        for n in SIZES:
            for i in range(len(w) + 3 - n):
                g = f" {w} "[i : i + n]
                counts[g] = counts.get(g, 0) + 1
    return sorted(counts, key=lambda g: (-counts[g], g.encode()))[:PROFILE]


PROFILES = {lang: profile(own) for lang, own in V.PROFILE_WORDS.items()}


def grams(words: Column) -> Column:
    """All n-grams of padded words, with repeats."""

    def of(w: Column) -> Column:
        def size(n: int) -> Column:
            return F.transform(F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(w, i, F.lit(n)))

        return F.flatten(F.array(*[size(n) for n in SIZES]))

    return F.flatten(F.transform(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), lambda w: of(w)))


def ranked(words: Column) -> Column:
    """The text's own profile: a sort, and the lengths of equal runs in it."""

    def counted(s: Column) -> Column:
        n = F.size(s)
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(every, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def runs(at: Column) -> Column:
            each = F.transform(at, lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), n)).alias("n"), F.get(s, i).alias("g")))
            return F.transform(F.slice(F.array_sort(each), 1, PROFILE), lambda x: x["g"])

        return T.let(starts, runs)

    return T.let(F.array_sort(grams(words)), counted)


def distances(own: Column) -> Column:
    """array<struct<distance, k>> of a profile's out-of-place distance to each language, in the order of PROFILES."""

    def to(known: list[str]) -> Column:
        table = T.strings(known)

        def place(g: Column, r: Column) -> Column:
            at = F.array_position(table, g)
            return F.abs(F.when(at > 0, at - 1).otherwise(PROFILE) - r)

        return F.aggregate(F.transform(own, place), F.lit(0).cast("long"), lambda s, x: s + x)

    return F.array(*[F.struct(to(p).alias("distance"), F.lit(k).alias("k")) for k, p in enumerate(PROFILES.values())])


RANKS = [{g: r for r, g in enumerate(own)} for own in PROFILES.values()]


@lru_cache(1 << 16)
def grams_of(word: str) -> list[str]:
    """All n-grams of a padded word, with repeats."""
    p = f" {word} "
    return [p[i : i + n] for n in SIZES for i in range(len(p) + 1 - n)]


def measures(text: str | None) -> tuple[int, list[int]]:
    """N-grams of the profile of a text of words, and its distance to each language."""
    counts: dict[str, int] = {}
    for w, n in Counter((text or "").split(" ")).items():
        for g in grams_of(w) if w else ():
            counts[g] = counts.get(g, 0) + n
    if len(counts) > PROFILE:  # only those as common as the last one can be in it
        least = heapq.nlargest(PROFILE, counts.values())[-1]
        counts = {g: n for g, n in counts.items() if n >= least}
    own = sorted(counts, key=lambda g: (-counts[g], g.encode()))[:PROFILE]
    return len(own), [sum(abs(known.get(g, PROFILE) - r) for r, g in enumerate(own)) for known in RANKS]


class Numbers(dict):
    """What is looked up gets the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(code, word, RANKS) of all n-grams of padded words, word by word: numbers in byte order, with repeats, and each code's place in each profile.

    None if the words hold too many different characters for such numbers.
    """
    points = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) + 2 for w in words], np.int64)
    there = np.zeros(0x110000, bool)
    there[points] = True
    alphabet = np.flatnonzero(there)
    bits = len(alphabet).bit_length()
    if SIZES[-1] * bits > 63:
        return None
    letter = np.zeros(0x110000, np.int64)
    letter[alphabet] = np.arange(1, len(alphabet) + 1)  # 0 stands after the end of a shorter n-gram, and so before all others
    at, end = letter[points], np.repeat(np.cumsum(size), size)
    word, place = np.repeat(np.arange(len(words)), size), np.arange(len(points))
    key, found = np.zeros(len(points), np.int64), []
    for k in range(SIZES[-1]):
        ok = place + k < end
        key = key << bits | np.where(ok, at[np.minimum(place + k, len(at) - 1)], 0)
        if k + 1 in SIZES:
            found.append(np.where(ok, key << bits * (SIZES[-1] - k - 1), 0))
    code, word = np.stack(found, 1).ravel(), np.repeat(word, len(SIZES))
    code, word = code[code > 0], word[code > 0]
    distinct, code = np.unique(code, return_inverse=True)
    rank = np.full((len(RANKS), len(distinct)), PROFILE, np.int64)
    for own, known in zip(rank, RANKS, strict=True):
        for g, r in known.items():
            codes = [int(letter[ord(c)]) for c in g]
            if all(codes):
                n = sum(c << bits * (SIZES[-1] - 1 - k) for k, c in enumerate(codes))
                i = int(np.searchsorted(distinct, n))
                if i < len(distinct) and distinct[i] == n:
                    own[i] = r
    return code, word, rank


def measures_of(texts: list[str]) -> list[tuple[int, list[int]]]:
    """measures() of a few texts at once: n-grams are made of each of their words once."""
    seen, size, word = Numbers(), [], []
    for t in texts:
        own = [w for w in t.split(" ") if w]
        word += map(seen.__getitem__, own)
        size.append(len(own))
    known = coded(list(seen)) if seen else None
    if known is None:
        return [measures(t) for t in texts]
    code, of, rank = known
    start = np.searchsorted(of, np.arange(len(seen) + 1))
    out, k, word = [], 0, np.array(word)
    for n in size:
        w, times = np.unique(word[k : k + n], return_counts=True)
        k += n
        many = start[w + 1] - start[w]
        at = np.repeat(start[w] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        count = np.bincount(code[at], np.repeat(times, many), rank.shape[1])
        own = np.flatnonzero(count)  # in byte order
        count = count[own]
        if len(own) > PROFILE:  # only those as common as the last one can be in it
            common = count >= np.partition(count, -PROFILE)[-PROFILE]
            own, count = own[common], count[common]
        own = own[np.argsort(-count, kind="stable")[:PROFILE]]
        out.append((len(own), np.abs(rank[:, own] - np.arange(len(own))).sum(1).tolist()))
    return out


#: Texts that are measured together, and their bytes.
ROWS, CHARS = 256, 1 << 20


def blocks(many: pa.Array, texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of rows that are measured together, of which each has so many of the texts."""
    size = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(texts), 0).to_numpy()))[np.cumsum(pc.fill_null(many, 0).to_numpy())]
    k = 0
    while k < len(many):
        to = max(k + 1, min(k + ROWS, int(np.searchsorted(size, (size[k - 1] if k else 0) + CHARS, "right"))))
        yield k, to
        k = to


def measured(words: Column) -> Column:
    """struct<grams, distance>: as ranked() and distances(), counted in Arrow batches; not for use inside lambdas.

    As expressions this sorts every n-gram of a text, as a grouping it shuffles them all.
    """
    return measured_text(F.array_join(words, " "))


def measured_text(text: Column) -> Column:
    """measured() of a text whose words stand between spaces."""

    @F.arrow_udf("grams int, distance array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        found = []
        for k, to in blocks(pa.array(np.ones(len(texts), np.int32)), texts):
            found += measures_of([t or "" for t in texts.slice(k, to - k).to_pylist()])
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int32()), pa.array([d for _, d in found], pa.list_(pa.int64()))], ["grams", "distance"])

    return of.asNondeterministic()(text)  # else a filter on what it gives is moved below and counts every text again


def nearest(d: Column) -> Column:
    """The language of the first of sorted struct<distance, k>, if it is clearly nearer than the second."""
    best, second = F.get(d, F.lit(0)), F.get(d, F.lit(1))
    return F.when(best["distance"] < NEARER * second["distance"], F.get(T.strings(list(PROFILES)), best["k"])).otherwise("unknown")


def named_by(n_words: Column, m: Column) -> Column:
    """As named(), from the number of words and what measured() gives."""
    d = F.sort_array(F.transform(m["distance"], lambda x, k: F.struct(x.alias("distance"), k.alias("k"))))
    return F.when((n_words >= LEAST_WORDS) & (m["grams"] >= LEAST_GRAMS), nearest(d)).otherwise("unknown")


def named(words: Column) -> Column:
    """The language whose profile is clearly nearest, else unknown: of at least six words and eight different n-grams."""

    def of(own: Column) -> Column:
        return F.when(F.size(own) >= LEAST_GRAMS, T.let(F.array_sort(distances(own)), nearest)).otherwise("unknown")

    return F.when(F.size(words) >= LEAST_WORDS, T.let(ranked(words), of)).otherwise("unknown")


def foreign(words: Column, supported: list[str]) -> Column:
    """Whether a language is named that is not supported."""
    return T.let(named(words), lambda x: (x != "unknown") & ~x.isin(*supported))


FUNCTION_WORDS = {code: frozenset(own) for code, own in V.FUNCTION_WORDS.items()}


def by_function_words(words: list[str]) -> str:
    """T.function_word_language() of a list of words."""
    best = (-1, 0.0, "unknown")
    for code, own in FUNCTION_WORDS.items():
        hits, share = len(own.intersection(words)), sum(w in own for w in words) / len(words)
        if hits > best[0] or hits == best[0] and share > best[1]:
            best = (hits, share, code)
    return best[2] if len(words) >= FLOOR and best[0] >= 3 and best[1] >= 0.04 else "unknown"


def name(grams: int, distance: list[int]) -> str:
    """The language of what measures() gives for six words or more, as named() names it."""
    (best, k), (second, _) = sorted((d, k) for k, d in enumerate(distance))[:2]
    return list(PROFILES)[k] if grams >= LEAST_GRAMS and best < NEARER * second else "unknown"


def unreads(texts: list[str], supported: list[str]) -> list[bool]:
    """Whether each normalised text of twelve words or more is in no supported language; under twice that, only where another one is named."""
    out, open_ = [False] * len(texts), []
    for i, t in enumerate(texts):
        words = [w for w in t.split(" ") if w]
        if len(words) >= FLOOR and (known := by_function_words(words)) not in supported:
            if known != "unknown" and len(words) >= 2 * FLOOR:
                out[i] = True
            else:
                open_.append((i, known, len(words)))
    for (i, known, n), m in zip(open_, measures_of([texts[i] for i, _, _ in open_]), strict=True):
        x = name(*m)
        guess = known == "unknown" and x in FUNCTION_WORDS and x in supported
        out[i] = not guess and (n >= 2 * FLOOR or x != "unknown" and x not in supported)
    return out


def any_unread(parts: Column, supported: list[str]) -> Column:
    """Whether any of an array of normalised texts is unread, looked at in Arrow batches; not for use inside lambdas. The first is looked at first, the others where it is not."""

    @F.arrow_udf("boolean")
    def of(rows: pa.Array) -> pa.Array:
        out: list[bool] = []
        for k, to in blocks(pc.list_value_length(rows), rows.flatten()):
            some = [[t or "" for t in r or ()] for r in rows.slice(k, to - k).to_pylist()]
            found = unreads([r[0] if r else "" for r in some], supported)
            rest = [(i, t) for i, r in enumerate(some) if not found[i] for t in r[1:]]
            for (i, _), x in zip(rest, unreads([t for _, t in rest], supported), strict=True):
                found[i] = found[i] or x
            out += found
        return pa.array(out, pa.bool_())

    return of(parts)
