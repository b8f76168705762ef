"""Variant spellings of one person's name, linked.

A record's name words become character n-gram vectors (two and three letters, word ends marked), weighted by inverse document
frequency over all records. Records meet by sparse keys: one birth date with an equal zip code, county or name word; two of the birth
parts with the beginnings of both names; the zip code and two birth parts with the beginning of one name. Of all pairs that meet, those with a cosine
of COSINE or more (all of them, not only the best few) go to an exact check of names, births and places. Average-linkage
clustering of the checked similarities within connected components gives the groups, so that one ambiguous record (an initial,
say) doesn't chain two people together. Equal records are one node.

Everything is done on arrays, in batches of whole birth dates; persons without a link to another birth date are settled there. A birth date of
more than WHOLE x max_block records is divided by its keys, and keys of more than max_block records into tiles, every pair of tiles being a
block of its own; no pair depends on the size of its block.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.copies import same_parts
from kinforge.llm.grouping import components
from kinforge.llm.namebatch import FIELDS, Names, Slices, distinct, gathered, joined, mixed, number
from kinforge.llm.personrows import NO_YEAR, SEPARATOR, name_statistics, numbers, packed, parts, text, unpacked, unpacked_numbers
from kinforge.session import small, stash

COSINE = 0.2
LINKAGE = 0.3
MAX_BLOCK = 4096
#: Times max_block that a birth date may have before it is divided: its records come together as arrays anyway.
WHOLE = 8
#: Keys of a bucket, about, and how many are held before hot keys leave it: 22 bytes each when shuffled, 32 in memory.
BUCKET, HELD = 400_000, 2_000_000
#: Tasks that add up the records of the births.
BIRTHS = 8
#: Records of a batch, and pairs that are compared at once: some 100 MB of a worker's memory.
BATCH, PAIRS = 40_000, 60_000


class WordGrams:
    """The n-grams of the words of a batch with their weights, and the square of each word's length as a vector."""

    def __init__(self, names: Names, idf: tuple[np.ndarray, np.ndarray, float]):
        codes, weights, most = idf
        n = len(names.words.texts)
        word, self.gram, each = _grams(names.words.texts)
        at = np.minimum(np.searchsorted(codes, each), max(len(codes) - 1, 0))
        self.weight = (np.where(codes[at] == each, weights[at], most) if len(codes) else np.full(len(each), most))[self.gram]
        self.n_grams = max(len(each), 1)
        self.of_word = Slices.of_sizes(np.bincount(word, minlength=n), np.arange(len(word)))
        self.square = np.append(np.bincount(word, self.weight * self.weight, n), 0.0)  # -1 is the last, no word
        self.fields = [names.of_first, names.of_last, names.of_rest, names.of_middle, names.of_other]
        length = np.sqrt(self.square)
        self.longest = sum(length[of] for of in self.fields)

    def surely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the fields that two records have in common suffice for a cosine of COSINE: weights are positive, so what they share is
        at least the squares of these words, and a record's vector is no longer than its words' vectors one after the other."""
        shared = sum(np.where(of[i] == of[j], self.square[of[i]], 0.0) for of in self.fields[:4])
        return shared > (COSINE + 1e-9) * self.longest[i] * self.longest[j]


class Vectors:
    """n-gram vectors of records of a batch (all, or those of rows): sorted (record, gram) entries with weights, of length 1."""

    def __init__(self, names: Names, idf: tuple[np.ndarray, np.ndarray, float], rows: np.ndarray | None = None, grams: WordGrams | None = None):
        grams = grams or WordGrams(names, idf)
        rows = np.arange(len(names.n_units)) if rows is None else rows
        n = len(rows)
        fields = [f[rows] for f in (names.of_first, names.of_last, names.of_rest, names.of_other, names.of_middle)]
        whole = joined(*[Slices.of_sizes((f >= 0).astype(np.int64), f[f >= 0]) for f in fields])
        self.n_grams = grams.n_grams
        entries = grams.of_word.take(whole.values)
        owner = whole.owners()[entries.owners()]
        key = owner * self.n_grams + grams.gram[entries.values]
        order = np.argsort(key)  # a gram has one weight, so the order of equal keys is nothing to the sums
        key, value = key[order], grams.weight[entries.values][order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.key = key[first]
        value = np.add.reduceat(value, first) if len(first) else value
        owner, self.gram = np.divmod(self.key, self.n_grams)
        norm = np.sqrt(np.bincount(owner, value * value, n))
        self.value = value / norm[owner]
        self.lists = Slices.of_sizes(np.bincount(owner, minlength=n), np.arange(len(self.key)))

    def cosines(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The cosine of each pair, summed over the entries of j that i has too (pairs come in the order of i, so that the search
        stays in one place)."""
        some = self.lists.take(j)
        owner = some.owners()
        key = self.gram[some.values] + i[owner] * self.n_grams
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        both = self.key[at] == key if len(key) else np.zeros(0, bool)
        return np.bincount(owner[both], self.value[some.values[both]] * self.value[at[both]], len(i))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place of the gram, grams): the different n-grams of each word, and all of them as numbers of their letters."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    two = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
    three = np.flatnonzero(owner[2:] == owner[:-2]) if len(flat) > 2 else np.zeros(0, np.int64)
    gram = np.concatenate((flat[two] << 21 | flat[two + 1], flat[three] << 42 | flat[three + 1] << 21 | flat[three + 2]))
    word = np.concatenate((owner[two], owner[three]))
    each, place = np.unique(gram, return_inverse=True)
    word, place = np.divmod(distinct(word * max(len(each), 1) + place), max(len(each), 1))
    return word, place, each


def _weights(idf: dict[str, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """The statistics as sorted gram numbers, their weights, and the weight of all others."""
    code = lambda g: ord(g[0]) << 21 | ord(g[1]) if len(g) == 2 else ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
    known = sorted((code(g), w) for g, w in idf.items())
    return np.array([c for c, _ in known], np.int64), np.array([w for _, w in known], float), max(idf.values(), default=1.0)


class People:
    """The records of a batch: names, packed births, zip codes and counties."""

    def __init__(self, columns: list[pa.Array], born: np.ndarray, zips: np.ndarray, counties: np.ndarray, established, idf):
        self.columns, self.born, self.zips, self.counties = columns, born, zips, counties
        self.names = Names(columns, established)
        self.idf, self.grams = idf, WordGrams(self.names, idf)

    def links(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The similarity of the names of each pair, 0 for different people."""
        out = np.zeros(len(i))
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            same = self.born[a] == self.born[b]
            some = np.flatnonzero(same | births_near(self.born[a], self.born[b]))
            # most pairs fail by their names, which costs less than their vectors
            middle = self.names.middles(a[some], b[some])
            some, middle = some[middle >= 0], middle[middle >= 0]
            for which, compared in ((same[some], self._born_alike), (~same[some], self._born_near)):
                if which.any():
                    score = compared(a[some[which]], b[some[which]], middle[which])
                    good = np.flatnonzero(score)
                    x = some[which][good]
                    out[at + x] = np.where(self._near_vectors(a[x], b[x]), score[good], 0.0)
        return out

    def _near_vectors(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the cosine of each pair is COSINE or more."""
        out = self.grams.surely(i, j)
        rest = np.flatnonzero(~out)
        rows, at = np.unique(np.concatenate((i[rest], j[rest])), return_inverse=True)
        vectors = Vectors(self.names, self.idf, rows, self.grams)
        out[rest] = vectors.cosines(at[: len(rest)], at[len(rest) :]) >= COSINE - 1e-9
        return out

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The places of the pairs that the letters of their names leave."""
        out = [np.zeros(0, np.int64)]
        for at in range(0, len(i), PAIRS):
            some = at + np.flatnonzero(self.names.letters_fit(i[at : at + PAIRS], j[at : at + PAIRS]))
            a, b = i[some], j[some]
            out.append(some[self.names.possible(a, b) | (self._letters[a] == self._letters[b])])
        return np.concatenate(out)

    def _compared(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        zips = (self.zips[i] > 0) & (self.zips[i] == self.zips[j])
        near = zips | (self.counties[i] > 0) & (self.counties[i] == self.counties[j])
        return zips, near, np.maximum(self.names.found(i, j)[0], self.names.found(j, i)[0])

    def _born_alike(self, i: np.ndarray, j: np.ndarray, middle: np.ndarray) -> np.ndarray:
        _, near, name = self._compared(i, j)
        good = (name >= 0.6) & (near | (name >= 0.95) | (middle > 0) & (name >= 0.75)) | near & (name >= 0.5) & (middle > 0)
        score = np.where(good, name, 0.0)
        rest = np.flatnonzero(~good & near & (name < 0.6) & (middle >= 0))
        score[rest] = np.where(self.names.new_surnames(i[rest], j[rest]), 0.6, 0.0)
        score[middle < 0] = 0
        rest = rest[score[rest] == 0]
        for k in rest[self._letters[i[rest]] == self._letters[j[rest]]]:
            a, b = ([v for v in self._units(x) if v] for x in (i[k], j[k]))
            score[k] = 1.0 if a and same_parts(a, b) else 0.0
        return score

    def _born_near(self, i: np.ndarray, j: np.ndarray, middle: np.ndarray) -> np.ndarray:
        zips, near, name = self._compared(i, j)
        full = self.names.full_middles(i, j)
        at_zip = np.where(name >= 0.6, name, np.where(zips, 0.0, 0.0))
        lost = np.flatnonzero(zips & (name < 0.6))
        at_zip[lost] = np.where(self.names.new_surnames(i[lost], j[lost]), 0.6, 0.0)
        # a county holds many people: the middle names must agree, or a name be a rare one
        rare = np.zeros(len(i), bool)
        some = np.flatnonzero(near & ~zips & (name >= 0.75) & (middle <= 0))
        rare[some] = self.names.rare_shared(i[some], j[some])
        at_county = near & (name >= 0.6) & ((middle > 0) | (name >= 0.75) & rare)
        elsewhere = full & (name >= 0.75)
        return np.where(middle < 0, 0.0, np.where(zips, at_zip, np.where(at_county | elsewhere, name, 0.0)))

    def _units(self, k: int) -> list[str]:
        n = self.names
        return [" ".join(n.words.texts[v] for v in p.values[p.at[k] : p.at[k + 1]]) for p in (n.first, n.last, n.rest)]

    @property
    def _letters(self) -> np.ndarray:
        """A number for the letters of each record's units, in any order."""
        if not hasattr(self, "_sums"):
            w = self.names.words
            hashed = np.zeros(len(w.texts), np.int64)
            for k in range(w.letters.shape[1]):
                c = w.letters[:, k].astype(np.int64)
                hashed += np.where(c > 0, mixed(c).view(np.int64) >> 8, 0)
            self._sums = sum(np.where(of >= 0, hashed[of] if len(hashed) else 0, 0) for of in (self.names.of_first, self.names.of_last, self.names.of_rest))
        return self._sums


def births_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two different birth dates differ by one missing part, a year, up to three days, or exchanged day and month."""
    (y1, m1, d1), (y2, m2, d2) = parts(a), parts(b)
    no = lambda y: y == NO_YEAR
    months = (y1 == y2) & (d1 == d2) & ~no(y1) & (d1 > 0) & ((m1 == 0) | (m2 == 0))
    days = (y1 == y2) & (m1 == m2) & ((d1 == 0) | (d2 == 0) | (np.abs(d1 - d2) <= 3))
    years = (m1 == m2) & (d1 == d2) & (no(y1) | no(y2) | np.isin(np.abs(y1 - y2), (1, 99)))
    return (a != b) & (months | days | years | (y1 == y2) & (m1 == d2) & (d1 == m2))


def pairs_of(keys: np.ndarray, rows: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different rows with an equal key, in pieces."""
    order = np.argsort(keys)
    keys, rows = keys[order], rows[order]
    last = np.flatnonzero(np.concatenate((keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(0, np.int64)
    end = np.repeat(last + 1, np.diff(last, prepend=-1))
    follow = end - np.arange(len(keys)) - 1
    open_ = np.flatnonzero(follow)
    total = np.cumsum(follow[open_])
    at = 0
    while at < len(open_):
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        lead = open_[at:stop]
        n = follow[lead]
        ends = np.cumsum(n)
        j = np.repeat(lead + 1 - (ends - n), n) + np.arange(ends[-1])
        i = np.repeat(lead, n)
        a, b = rows[i], rows[j]
        keep = a != b
        yield np.minimum(a, b)[keep], np.maximum(a, b)[keep]
        at = stop


def _meeting(people: People, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) that records of one birth date meet by: zip code, county, each name field as a whole."""
    born = people.born
    rows, keys = [], []
    for kind, value, has in [(1, people.zips, people.zips > 0), (2, people.counties, people.counties > 0)] + [(3, people.names.plain_text[of], of >= 0) for of in (people.names.of_first, people.names.of_last, people.names.of_rest, people.names.of_other)]:
        at = np.flatnonzero(has)
        rows.append(at)
        keys.append(mixed(block[at], born[at], kind, value[at]))
    return np.concatenate(rows), np.concatenate(keys)


_WORDS = regex.compile(r"[^\p{L}\p{N}\p{M}]+")


@lru_cache(maxsize=200_000)
def _field(text: str) -> str:
    return _WORDS.sub(" ", text.lower()).strip()


def name_classes(names: list[list[str]]) -> list[int]:
    """For each name (fname, lname, suffix) the first one that contains the same name parts. Only names of the same letters are
    compared."""
    out: list[int] = []
    equal: dict = {}
    alike: dict = defaultdict(list)
    for n in names:
        fields = [f for f in map(_field, n) if f]
        key = tuple(sorted(f.replace(" ", "") for f in fields))
        if key not in equal:
            letters = "".join(sorted("".join(key)))
            tokens = sorted(" ".join(fields).split(" "))  # fields of the same tokens can be cut at every space
            equal[key] = next((k for k, f, t in alike[letters] if t == tokens or same_parts(f, fields)), len(out))
            if equal[key] == len(out):
                alike[letters].append((len(out), fields, tokens))
        out.append(equal[key])
    return out


def _name_codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each record's names: equal for the same set of names without spaces, and for the same letters in any order."""
    encoded = [c.dictionary_encode() for c in columns]
    every = _squeezed(pa.concat_arrays([pa.array([""]), *[pc.cast(d.dictionary, pa.string()) for d in encoded]])).dictionary_encode()
    texts, numbers = every.dictionary.to_pylist(), every.indices.to_numpy().astype(np.int64)
    begin, codes = 1, []
    for d in encoded:
        each = np.append(numbers[begin : begin + len(d.dictionary)], 0)
        begin += len(d.dictionary)
        codes.append(each[pc.fill_null(d.indices, len(each) - 1).to_numpy()])
    letters = mixed(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)).view(np.int64) if len(texts) > 1 else np.zeros(0, np.int64)
    sums = np.concatenate(([0], np.cumsum(letters)))
    ends = np.cumsum([len(t) for t in texts])
    letters = sums[ends] - sums[np.concatenate(([0], ends[:-1]))]
    same = np.zeros(len(codes[0]), np.int64)
    for c in np.sort(np.stack(codes), axis=0):
        _, same = np.unique(same * len(texts) + c, return_inverse=True)
    return same, sum(letters[c] for c in codes)


def _squeezed(texts: pa.Array) -> pa.Array:
    """_field of each text, without spaces."""
    plain = pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
    out = pc.replace_substring_regex(pc.ascii_lower(texts), "[^a-z0-9]+", "")
    if plain.all():
        return out
    rest = [_field(t).replace(" ", "") for t in texts.filter(pa.array(~plain)).to_pylist()]
    return pc.replace_with_mask(out, pa.array(~plain), pa.array(rest, pa.string()))


def spelling_classes(person: np.ndarray, ids: np.ndarray, columns: list[pa.Array]) -> np.ndarray:
    """The smallest id of each person's records with the same name parts; columns: fname, lname, suffix. Persons whose names have the same
    letters in other parts are left to name_classes."""
    if not len(ids):
        return ids
    same, anagram = _name_codes(columns)
    order = np.lexsort((ids, same, anagram, person))
    p, a, c = person[order], anagram[order], same[order]
    new_p = np.concatenate(([True], p[1:] != p[:-1])) if len(p) else np.zeros(0, bool)
    new_a = new_p | np.concatenate(([True], a[1:] != a[:-1])) if len(p) else new_p
    new_c = new_a | np.concatenate(([True], c[1:] != c[:-1])) if len(p) else new_p
    out = _of_first(ids, order, new_c)
    # one record of each of the parts stands for all of them
    group = np.cumsum(new_a) - 1
    some = np.flatnonzero(new_c & np.isin(group, group[new_c & ~new_a]))
    some = some[np.lexsort((ids[order[some]], group[some]))]
    names = [[v or "" for v in n] for n in zip(*[c.take(pa.array(order[some])).to_pylist() for c in columns])]
    ends = np.concatenate((np.flatnonzero(np.diff(group[some])) + 1, [len(some)])) if len(some) else ()
    begin = 0
    for end in ends:
        for k, c in enumerate(name_classes(names[begin:end])):
            if c != k:
                out[order[some[begin + k]]] = ids[order[some[begin + c]]]
        begin = end
    return _of_first(out, order, new_c)


def _of_first(values: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """values, where all rows of a run (in this order, new where one begins) take the value of its first row."""
    out = values.copy()
    if len(order):
        out[order] = values[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number linked to each of n numbers, itself included."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def local_linkage(ids: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The person (smallest id) of each record by average linkage within its component; each pair once. A component all of whose pairs are
    linked well enough is one person."""
    person = ids.copy()
    n, m = np.bincount(root, minlength=len(ids)), np.bincount(root[i], minlength=len(ids))
    worst = np.ones(len(ids))
    np.minimum.at(worst, root[i], s)
    whole = (m == n * (n - 1) // 2) & (worst >= LINKAGE)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    person[whole[root]] = least[root][whole[root]]
    rest = np.flatnonzero(~whole[root[i]])
    rest = rest[np.argsort(root[i[rest]], kind="stable")]
    for some in np.split(rest, np.flatnonzero(np.diff(root[i[rest]])) + 1) if len(rest) else ():
        a, b, sims = i[some], j[some], s[some]
        nodes = distinct(np.concatenate((a, b)))
        nodes = nodes[np.argsort(ids[nodes], kind="stable")]
        at = {x: k for k, x in enumerate(nodes.tolist())}
        member = average_linkage(len(nodes), {(min(at[x], at[y]), max(at[x], at[y])): v for x, y, v in zip(a.tolist(), b.tolist(), sims.tolist())}, LINKAGE)
        person[nodes] = ids[nodes[_first_of(member)]]
    return person


def _first_of(member: list[int]) -> np.ndarray:
    """For each item the first one of its cluster."""
    first: dict[int, int] = {}
    return np.array([first.setdefault(m, k) for k, m in enumerate(member)], np.int64)


#: kind L: nodes a and b are linked with similarity s; N: node a bears the name; C: record a equals node b; D: record a is settled, it belongs
#: to person b and has spelling c.
_SCHEMA = "kind string, a bigint, b bigint, c bigint, s double, name string"
_ROW = ("id", "names", "p")


def _said(kind: str, a, b=None, c=None, s=None, name=None) -> Iterator[pa.RecordBatch]:
    none = lambda x, t: pa.nulls(len(a), t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t)
    columns = {"kind": pa.repeat(kind, len(a)), "a": pa.array(a, pa.int64()), "b": none(b, pa.int64()), "c": none(c, pa.int64()), "s": none(s, pa.float64()), "name": none(name, pa.string())}
    yield from pa.table(columns).to_batches(20_000)


def _said_links(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
    return _said("L", np.minimum(a, b), np.maximum(a, b), s=s)


def _linked(people: People, n: int, pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links among the pairs of n records, each once."""
    codes, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, j in pieces:
        some = people.may_link(i, j)
        each = distinct(i[some] * n + j[some])
        s = people.links(each // n, each % n)
        codes.append(each[s > 0])
        scores.append(s[s > 0])
    each, first = np.unique(np.concatenate(codes), return_index=True)
    return each // n, each % n, np.concatenate(scores)[first]


def _texts(people: People, some: np.ndarray) -> list[pa.Array]:
    return [people.columns[k].take(pa.array(some)) for k in (0, 2, 4)]


def _people(t: pa.Table, established, idf) -> People:
    return People(unpacked(t["names"].combine_chunks()), *unpacked_numbers(number(t["p"])), established, idf)


def _in_blocks(established: dict[str, float], idf: dict[str, float]):
    """(block, _ROW, h, g, open) sorted by block -> _SCHEMA: persons of the records of a block with one birth date. Components with a record
    that is open (has links elsewhere, or stands in several blocks) come out as links and names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, held = _weights(idf), None
        for t in chain(gathered(batches, BATCH), [None]):
            if t is not None:
                t = pa.concat_tables([held, t]) if held is not None else t
                block = number(t["block"])
                cut = int(np.searchsorted(block, block[-1]))
                held, t = t.slice(cut), t.slice(0, cut).combine_chunks()
            else:
                t = held
            if t is not None and t.num_rows:
                yield from _settled(t.combine_chunks(), established, weights)

    return run


def _settled(t: pa.Table, established, weights) -> Iterator[pa.RecordBatch]:
    block, ids, h, g = (number(t[c]) for c in ("block", "id", "h", "g"))
    order = np.lexsort((ids, g, h, block))
    block, ids, h, g = block[order], ids[order], h[order], g[order]
    # equal records are one node, the one with the smallest id
    new = np.concatenate(([True], (block[1:] != block[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
    of = np.cumsum(new) - 1
    several = np.bincount(of) > 1
    first = np.flatnonzero(new)
    node, home = ids[first], block[first]
    several &= np.maximum.reduceat(ids, first) > node
    left = home[1:] == home[:-1]
    company = np.concatenate(([False], left)) | np.concatenate((left, [False])) if len(home) else np.zeros(0, bool)
    some = np.flatnonzero(company | several)
    if not len(some):
        return
    t = t.take(pa.array(order[first[some]])).combine_chunks()
    people = _people(t, established, weights)
    node, n = node[some], len(some)
    rows, keys = _meeting(people, home[some])
    i, j, s = _linked(people, n, pairs_of(keys, rows))
    root = local_components(n, i, j)
    linked = np.bincount(np.concatenate((i, j)), minlength=n) > 0
    open_ = np.zeros(n, bool)
    open_[root[t["open"].to_numpy()]] = True
    open_ = open_[root]
    out = linked | several[some]  # what is a person's at all
    person = local_linkage(node, root, i, j, s)
    done = np.flatnonzero(out & ~open_)
    spelling = node.copy()
    many = done[linked[done]]
    spelling[many] = spelling_classes(person[many], node[many], _texts(people, many))
    yield from _said("D", node[done], person[done], spelling[done])
    where = np.full(len(first), -1, np.int64)
    where[some] = np.arange(n)
    k = where[of]
    copy = np.flatnonzero((k >= 0) & ~new)
    copy = copy[(ids[copy] > node[k[copy]]) & np.concatenate(([True], (ids[copy][1:] != ids[copy][:-1]) | (k[copy][1:] != k[copy][:-1])))[: len(copy)]] if len(copy) else copy
    k = k[copy]
    yield from _said("D", ids[copy][~open_[k]], person[k][~open_[k]], spelling[k][~open_[k]])
    yield from _said("C", ids[copy][open_[k]], node[k][open_[k]])
    left = open_[i]
    yield from _said_links(node[i[left]], node[j[left]], s[left])
    rest = np.flatnonzero(out & open_)
    yield from _said("N", node[rest], name=pc.binary_join_element_wise(*_texts(people, rest), SEPARATOR))


def _of_pairs(established: dict[str, float], idf: dict[str, float]):
    """(a, b, record of each) -> _SCHEMA: links and names of those linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _weights(idf)
        for t in gathered(batches, BATCH):
            ids = np.concatenate((number(t["a"]), number(t["b"])))
            each, rows, at = np.unique(ids, return_index=True, return_inverse=True)
            sides = pa.concat_tables([t.select([f"{s}_{c}" for c in _ROW[1:]]).rename_columns(list(_ROW[1:])) for s in "ab"])
            people = _people(sides.take(pa.array(rows)), established, weights)
            i, j, s = _linked(people, len(each), iter([(at[: t.num_rows], at[t.num_rows :])]))
            yield from _said_links(each[i], each[j], s)
            some = distinct(np.concatenate((i, j)))
            yield from _said("N", each[some], name=pc.binary_join_element_wise(*_texts(people, some), SEPARATOR))

    return run


def average_linkage(n: int, sims: dict[tuple[int, int], float], least: float) -> list[int]:
    """Cluster number (smallest member) of each of n items; pairs that sims leaves out have similarity 0. Ties: the smaller numbers first."""
    members = {i: [i] for i in range(n)}
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for (i, j), s in sims.items():
        near[i][j] = near[j][i] = s
    heap = [(-s, i, j) for (i, j), s in sims.items()]
    heapq.heapify(heap)
    while heap:
        s, i, j = heapq.heappop(heap)
        if -s < least:
            break
        if i not in members or j not in members or near[i].get(j) is None or abs(near[i][j] / (len(members[i]) * len(members[j])) + s) > 1e-12:
            continue
        members[i] += members.pop(j)
        for k, w in near.pop(j).items():
            if k != i:
                near[i][k] = near[k][i] = near[i].get(k, 0.0) + w
                near[k].pop(j, None)
        near[i].pop(j, None)
        for k, w in near[i].items():
            heapq.heappush(heap, (-w / (len(members[i]) * len(members[k])), min(i, k), max(i, k)))
    out = [0] * n
    for i, some in members.items():
        for x in some:
            out[x] = i
    return out


def _linkage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, a, b, s) sorted by component -> (node, person)."""
    held = None
    for t in chain(gathered(batches, BATCH), [None]):
        if t is not None:
            t = pa.concat_tables([held, t]) if held is not None else t
            cut = pc.index(t["g"], t["g"][-1]).as_py()
            held, t = t.slice(cut), t.slice(0, cut)
        else:
            t = held
        if t is not None and t.num_rows:
            each, at = np.unique(np.concatenate((number(t["a"]), number(t["b"]))), return_inverse=True)
            i, j = at[: t.num_rows], at[t.num_rows :]
            person = local_linkage(each, local_components(len(each), i, j), i, j, t["s"].to_numpy())
            yield from pa.table({"node": each, "person": person}).to_batches(20_000)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(person, node, name) sorted by person -> (node, person, spelling)."""
    held = None
    for t in chain(gathered(batches, BATCH), [None]):
        if t is not None:
            t = pa.concat_tables([held, t]) if held is not None else t
            person = number(t["person"])
            cut = int(np.searchsorted(person, person[-1]))
            held, t = t.slice(cut), t.slice(0, cut)
        else:
            t = held
        if t is not None and t.num_rows:
            person, node = number(t["person"]), number(t["node"])
            spelling = spelling_classes(person, node, unpacked(t["name"].combine_chunks(), 3))
            yield from pa.table({"node": node, "person": person, "spelling": spelling}).to_batches(20_000)


#: A row in 22 bytes: 48 bits of key, p and h, the low 32 of id.
_SHRUNK = np.dtype([("key", "V6"), ("id", "V4"), ("p", "V6"), ("h", "V6")])


def _shrunk(rows: np.ndarray) -> np.ndarray:
    """Rows of key, id, p and h as _SHRUNK."""
    return _shrunk_columns(*rows.T)


def _shrunk_columns(key: np.ndarray, ids: np.ndarray, p: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.empty(len(key), _SHRUNK)
    for c, v in zip(_SHRUNK.names, (key, ids, p, h)):
        out[c] = np.ascontiguousarray(v).view(np.dtype({"names": ["x"], "formats": [_SHRUNK[c]], "itemsize": 8}))["x"]
    return out


def _grown(data, high: int) -> np.ndarray:
    """The rows of _shrunk; high: what the ids have above their low 32 bits."""
    lanes = np.frombuffer(data, np.uint16).reshape(-1, 11)
    out = np.zeros((len(lanes), 4, 4), np.uint16)
    out[:, 0, :3], out[:, 1, :2], out[:, 2, :3], out[:, 3, :3] = lanes[:, :3], lanes[:, 3:5], lanes[:, 5:8], lanes[:, 8:]
    out = out.reshape(len(lanes), 16).view(np.int64)
    out[:, 1] += high << 32
    return out


def _near_keys(buckets: int):
    """(_ROW, h) -> (bucket, high, data): what records with near birth dates meet by, as rows of four numbers: key, id, p and h. p packs birth,
    first letter (2 bits) of a full middle name, and as much of county (10 bits) and zip code (14) as tells most of them apart. Buckets below 0
    count the records of each birth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, BATCH):
            key, at, p = _keyed(unpacked(t["names"].combine_chunks()), *unpacked_numbers(number(t["p"])))
            ids = number(t["id"])
            highs, high = np.unique(ids >> 32, return_inverse=True)
            cell = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) * len(highs) + high[at]
            order = np.argsort(cell.astype(np.uint16) if cell.max(initial=0) < 1 << 16 else cell, kind="stable")
            row = at[order]
            data = _shrunk_columns(key.view(np.int64)[order], ids[row], p[row], number(t["h"])[row])
            ends = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=buckets * len(highs)))))
            whole = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 22).astype(np.int32)), pa.py_buffer(data)])
            some = np.flatnonzero(np.diff(ends))
            yield from pa.table({"bucket": some // len(highs), "high": highs[some % len(highs)], "data": whole.take(pa.array(some))}).to_batches()
            born, n = np.unique(number(t["p"]) & (1 << 21) - 1, return_counts=True)
            for k in range(BIRTHS):
                some = born % BIRTHS == k
                yield pa.RecordBatch.from_pydict({"bucket": [-1 - k], "high": [0], "data": [np.stack((born[some], n[some]), axis=1).astype(np.int64).tobytes()]})

    return run


def _keyed(columns: list[pa.Array], born: np.ndarray, zips: np.ndarray, counties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their rows, p of each row)."""
    names = Names(columns)
    w = names.words
    first, last = names.ends()
    begin = w.begin(3) if len(w.texts) else np.zeros(1, np.int64)
    f3, l3, o3 = (np.where(x >= 0, begin[x], 0) for x in (first, last, names.of_other))
    y, m, d = parts(born)
    has_y, has_m, has_d = y < NO_YEAR, m > 0, d > 0
    full = (names.of_middle >= 0) & (w.sizes[names.of_middle] >= 3) if len(w.texts) else np.zeros(len(y), bool)
    letter = np.where(full, w.first[names.of_middle] & 3, 0) if len(w.texts) else np.zeros(len(y), np.int64)
    p = born | (full.astype(np.int64) << 2 | letter) << 21 | np.where(counties > 0, 1 + counties % 1023, 0) << 24 | np.where(zips > 0, 1 + zips % 16383, 0) << 34
    rows, keys = [], []
    low, high = np.minimum(m, d), np.maximum(m, d)
    two = ((1, has_y & has_m, y, m), (2, has_y & has_d, y, d), (3, has_m & has_d, m, d), (4, has_y & has_m & has_d & (m != d) & (m <= 12) & (d <= 12), y, low << 7 | high))
    for k, which, x, z in two:
        part = k + x * 8 + z * 1024
        for other, named in ((l3, (first >= 0) & (last >= 0)), (o3, (first >= 0) & (names.of_other >= 0))):
            at = np.flatnonzero(which & named)
            keys.append(mixed(part[at], 5, np.minimum(f3, other)[at], np.maximum(f3, other)[at]))
            rows.append(at)
        for begins, named in ((f3, first >= 0), (l3, (last >= 0) & (l3 != f3))) if k != 2 else ():
            at = np.flatnonzero(which & named & (zips > 0))
            keys.append(mixed(part[at], 6, zips[at], begins[at]))
            rows.append(at)
    return np.concatenate(keys), np.concatenate(rows), p


def _near(key: np.ndarray, ids: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): the pairs of a key with near births that share a zip code, a county or the first letter of a full middle name."""
    for i, j in pairs_of(key, np.arange(len(key))):
        a, b = p[i], p[j]
        zips = (a >> 34, b >> 34)
        counties = (a >> 24 & 1023, b >> 24 & 1023)
        middle = (a >> 21 & 7, b >> 21 & 7)
        meets = (zips[0] > 0) & (zips[0] == zips[1]) | (counties[0] > 0) & (counties[0] == counties[1]) | (middle[0] > 3) & (middle[0] == middle[1])
        some = np.flatnonzero(meets & (ids[i] != ids[j]))
        some = some[births_near(a[some] & (1 << 21) - 1, b[some] & (1 << 21) - 1)]
        x, y = ids[i[some]], ids[j[some]]
        a, b = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        yield a[new], b[new]


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, p) sorted by key -> (a, b)."""
    held = None
    for t in chain(gathered(batches, 4 * BATCH), [None]):
        if t is not None:
            t = pa.concat_tables([held, t]) if held is not None else t
            key = number(t["key"])
            cut = int(np.searchsorted(key, key[-1]))
            held, t = t.slice(cut), t.slice(0, cut)
        else:
            t = held
        if t is not None and t.num_rows:
            for a, b in _near(*(number(t[c]) for c in ("key", "id", "p"))):
                yield from pa.table({"a": a, "b": b}).to_batches()


_NEAR = "a bigint, b bigint, p bigint, key bigint, h bigint"


def _hot(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from pa.table({"a": rows[:, 1], "b": pa.nulls(len(rows), pa.int64()), "p": rows[:, 2], "key": rows[:, 0], "h": rows[:, 3]}).to_batches(20_000)


def _nodes_only(rows: np.ndarray) -> np.ndarray:
    """Rows of a bucket without those of records that equal one with a smaller id (they have the same keys)."""
    _, at = np.unique(mixed(rows[:, 2], rows[:, 3]), return_inverse=True)
    least = np.full(at.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, at, rows[:, 1])
    return rows[rows[:, 1] == least[at]]


def _in_buckets(max_block: int, held_most: int = HELD):
    """(bucket, high, data) sorted by bucket -> _NEAR: pairs, and the rows of keys that more than max_block records have; births (as a, without
    p) that more than WHOLE x max_block have."""

    def crowded(rows: np.ndarray) -> np.ndarray:
        each, n = np.unique(rows[:, 0], return_counts=True)
        return each[n > max_block]

    def finished(blobs: list[np.ndarray], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(blobs)
        if len(hot):
            out = np.isin(rows[:, 0], hot)
            yield from _hot(rows[out])
            rows = rows[~out]
        for last in (False, True):  # rows alone with their key, before and after equal records are one
            order = np.argsort(np.ascontiguousarray(rows[:, 0]))
            key = rows[order, 0]
            same = key[1:] == key[:-1]
            order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(key) else order
            rows = rows[order] if last else _nodes_only(rows[order])
        hot = crowded(rows)
        if len(hot):
            out = np.isin(rows[:, 0], hot)
            yield from _hot(rows[out])
            rows = rows[~out]
        for a, b in _near(rows[:, 0], rows[:, 1], rows[:, 2]):
            none = pa.nulls(len(a), pa.int64())
            yield from pa.table({"a": a, "b": b, "p": none, "key": none, "h": none}).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blobs, n, most, hot, births = None, [], 0, held_most, np.zeros(0, np.int64), Counter()
        for batch in batches:
            for bucket, high, data in zip(batch["bucket"].to_pylist(), batch["high"].to_pylist(), batch["data"]):
                if bucket < 0:
                    for born, k in np.frombuffer(data.as_buffer(), np.int64).reshape(-1, 2).tolist():
                        births[born] += k
                    continue
                if bucket != held:
                    if blobs:
                        yield from finished(blobs, hot)
                    held, blobs, n, most, hot = bucket, [], 0, held_most, np.zeros(0, np.int64)
                blobs.append(_grown(data.as_buffer(), high))
                n += len(blobs[-1])
                if n > most:  # a hot key doesn't stay in memory
                    rows = _nodes_only(np.concatenate(blobs))
                    hot = np.union1d(hot, crowded(rows))
                    out = np.isin(rows[:, 0], hot)
                    yield from _hot(rows[out])
                    blobs = [rows[~out]]
                    n = len(blobs[0])
                    most = max(held_most, 2 * n)
        if blobs:
            yield from finished(blobs, hot)
        large = [b for b, k in births.items() if k > WHOLE * max_block]
        none = pa.nulls(len(large), pa.int64())
        yield from pa.table({"a": pa.array(large, pa.int64()), "b": none, "p": none, "key": none, "h": none}).to_batches()

    return run


def _tiled(keyed: DataFrame, max_block: int) -> DataFrame:
    """keyed (key, id, ...), the keys of more than max_block records divided into pairs of tiles."""
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max_block)
    large = stash(large.select("key", F.ceil(F.col("n") / (max_block // 2)).alias("tiles")), "p3-large")
    if large.isEmpty():
        return keyed
    tile = keyed.join(small(large), "key").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles"))
    cells = tile.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    cells = cells.withColumn("key", F.xxhash64("key", F.least("tile", "with"), F.greatest("tile", "with"))).select(*keyed.columns)
    return keyed.join(small(large), "key", "left_anti").select(*keyed.columns).unionByName(cells)


def _divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_ROW -> (key, id): the keys by which records of one birth date meet."""
    for t in gathered(batches, BATCH):
        people = People.__new__(People)
        people.names = Names(unpacked(t["names"].combine_chunks()))
        people.born, people.zips, people.counties = unpacked_numbers(number(t["p"]))
        rows, keys = _meeting(people, people.born)
        yield from pa.table({"key": keys.view(np.int64), "id": t["id"].take(pa.array(rows))}).to_batches()


def _near_births(rows: DataFrame, records: int, max_block: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): the pairs of records with near births that meet, equal records being one. Keys that are too large leave their bucket and are
    divided into tiles. Second the births (block) that more than WHOLE x max_block records have."""
    buckets = max(64, -(-8 * records // BUCKET))
    keyed = rows.select(*_ROW, "h").mapInArrow(_near_keys(buckets), "bucket bigint, high bigint, data binary")
    found = keyed.repartition(buckets // 2, "bucket").sortWithinPartitions("bucket").mapInArrow(_in_buckets(max_block), _NEAR)
    found = stash(found, "p3-found-near")
    pairs, hot = found.where("b is not null").select("a", "b"), found.where("b is null and p is not null")
    if not hot.isEmpty():
        nodes = stash(hot.groupBy("key", "h", "p").agg(F.min("a").alias("id")).select("key", "id", "p"), "p3-hot")
        cells = _tiled(nodes, max_block).repartition(F.col("key")).sortWithinPartitions("key")
        pairs = pairs.unionByName(cells.mapInArrow(_near_pairs, "a bigint, b bigint"))
    births = found.where("b is null and p is null").select(F.col("a").alias("block"))
    return stash(pairs.distinct(), "p3-near"), stash(births, "p3-births")


def _blocks(rows: DataFrame, hot: DataFrame, max_block: int) -> tuple[DataFrame, DataFrame | None]:
    """(block, _ROW, h, g, open): records by birth date; those of hot ones by what they meet by there, equal
    records being one: what is to say of these comes second, as _SCHEMA."""
    born = F.col("p").bitwiseAND(F.lit((1 << 21) - 1))
    plain = rows.select(born.alias("block"), *_ROW, "h", "g", "open")
    if hot.isEmpty():
        return plain, None
    crowd = plain.join(small(hot), "block", "left_semi")
    equal = stash(crowd.groupBy("block", "h", "g").agg(F.min("id").alias("node"), F.max("id").alias("_last")).where("node < _last").drop("_last"), "p3-equal")
    copies = stash(crowd.join(small(equal), ["block", "h", "g"]).select("id", "node").distinct(), "p3-copies")
    nodes = crowd.join(small(copies.where("id > node").select("id")), "id", "left_anti")
    keyed = nodes.select(*_ROW).mapInArrow(_divided, "key bigint, id bigint")
    cells = _tiled(keyed, max_block).withColumnRenamed("key", "block").join(nodes.drop("block", "open"), "id")
    cells = cells.select("block", *_ROW, "h", "g", F.lit(True).alias("open"))
    none = lambda t: F.lit(None).cast(t)
    say = lambda df, kind, b, name: df.select(F.lit(kind).alias("kind"), F.col("id").alias("a"), b.alias("b"), none("bigint").alias("c"), none("double").alias("s"), name.alias("name"))
    part = F.split("names", SEPARATOR)
    named = nodes.join(small(copies.where("id = node").select("id")), "id", "left_semi")
    said = say(copies.where("id > node"), "C", F.col("node"), none("string")).unionByName(say(named, "N", none("bigint"), F.concat_ws(SEPARATOR, part[0], part[2], part[4])))
    return plain.join(small(hot), "block", "left_anti").select(*plain.columns).unionByName(cells), said


def spellings(df: DataFrame, id_col: str = "idx", max_block: int = MAX_BLOCK) -> DataFrame:
    """(id, person, spelling) for each record that shares a person with another one: person is the smallest id of the
    person's records, spelling the smallest id of those whose fname, lname and suffix contain the same name parts.

    Records without any name word, with a NULL id, or with nobody to share a person with don't come out. Missing birth
    parts equal missing ones. Equal and repeated rows are one node, whatever their number, and come out as one person.
    """
    county = F.coalesce(F.col("county").cast("string"), F.lit(""))
    # equal records, by two hashes of all that counts
    raw = [c for c in (*FIELDS, "byear", "bmonth", "bday", "zipcode", "county") if c in df.columns]
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), *[text(df, c).alias(c) for c in FIELDS], *numbers(df, county), F.xxhash64(*raw).alias("h"), F.hash(*raw).alias("g"))
    rows = rows.select("id", *packed(list(FIELDS)), "h", "g")
    statistics = name_statistics(df, list(FIELDS[:4]), grams=True)
    near, hot = _near_births(rows, df.count(), max_block)
    met = stash(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "p3-met")
    some = stash(rows.join(small(met), "id", "left_semi").select(*_ROW), "p3-records")
    record = lambda s: some.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in _ROW[1:]])
    across = stash(near.join(record("a"), "a").join(record("b"), "b").mapInArrow(_of_pairs(*statistics), _SCHEMA), "p3-across")
    ends = stash(across.where("kind = 'N'").select(F.col("a").alias("id"), F.lit(True).alias("_open")).distinct(), "p3-ends")
    known = rows.join(small(ends), "id", "left").select(*rows.columns, F.col("_open").isNotNull().alias("open"))
    blocks, crowd = _blocks(known, hot, max_block)
    inside = stash(blocks.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(_in_blocks(*statistics), _SCHEMA), "p3-inside")
    said = reduce(DataFrame.unionByName, [inside, across] if crowd is None else [inside, across, crowd])
    links = stash(said.where("kind = 'L'").groupBy("a", "b").agg(F.max("s").alias("s")), "p3-pairs")
    group = components(links, "a", "b").select(F.col("group_id").alias("g"), F.col("member").cast("bigint").alias("a"))
    edges = links.join(group, "a").select("g", "a", "b", "s")
    person = edges.repartition(F.col("g")).sortWithinPartitions("g").mapInArrow(_linkage, "node bigint, person bigint")
    names = said.where("kind = 'N'").groupBy(F.col("a").alias("node")).agg(F.first("name").alias("name"))
    named = names.join(person, "node", "left").select(F.coalesce("person", "node").alias("person"), "node", "name")
    spelt = stash(named.repartition(F.col("person")).sortWithinPartitions("person").mapInArrow(_classes, "node bigint, person bigint, spelling bigint"), "p3-spelt")
    copies = said.where("kind = 'C'").select(F.col("a").alias("id"), F.col("b").alias("node")).distinct().join(spelt, "node").select("id", "person", "spelling")
    settled = inside.where("kind = 'D'").select(F.col("a").alias("id"), F.col("b").alias("person"), F.col("c").alias("spelling"))
    return settled.unionByName(spelt.select(F.col("node").alias("id"), "person", "spelling")).unionByName(copies)


def p3_spellings(spark, sf_dir: str) -> DataFrame:
    return spellings(spark.read.parquet(f"{sf_dir}/preprocess_file_template.parquet")).withColumnRenamed("id", "idx")


def p3_found(spark, sf_dir: str) -> DataFrame:
    found = stash(p3_spellings(spark, sf_dir), "p3-found")
    varied = found.groupBy("person").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a < b").select("person")
    some = found.join(varied, "person")
    left, right = some.select("person", F.col("idx").alias("idx_a"), F.col("spelling").alias("sa")), some.select("person", F.col("idx").alias("idx_b"), F.col("spelling").alias("sb"))
    return left.join(right, "person").where("idx_a < idx_b and sa <> sb").select("idx_a", "idx_b")
