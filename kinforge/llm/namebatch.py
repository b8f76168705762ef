"""Names compared by the hundred thousand: what nameparts says of one pair of names, as arrays over many pairs.

Names of a batch are parsed field by field, each different text once; their words are numbered, and a record becomes slices
of word numbers: its units (first name, last name, what stands in the suffix), all words that can be met, middle and other names. Word
pairs that can't be spellings of one name by first letter, length and letters are settled at once, the others are compared once each
by a banded edit distance over columns of letters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kinforge.llm.nameparts import NO_NAME, SHORT_FORMS, SUFFIXES, TITLES, Speller

FIELDS = ("fname", "mname", "lname", "altlname", "suffix")
#: Letters of a word that arrays hold; pairs with a longer word are compared one by one.
LETTERS = 48


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Arrow batches in tables of about so many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def number(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of some numbers of each row."""
    h = np.full(max((np.size(p) for p in parts), default=1), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p, np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(32))
    return h


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order: a sort costs much less here than np.unique's hash."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


class Slices:
    """A list of numbers for each record."""

    def __init__(self, at: np.ndarray, values: np.ndarray):
        self.at, self.values = at, values

    @classmethod
    def of_sizes(cls, sizes: np.ndarray, values: np.ndarray) -> Slices:
        return cls(np.concatenate(([0], np.cumsum(sizes))), values)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def take(self, rows: np.ndarray) -> Slices:
        sizes = self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(sizes)
        places = np.repeat(self.at[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return Slices(np.concatenate(([0], ends)), self.values[places])

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.sizes)

    def where(self, keep: np.ndarray) -> Slices:
        sizes = np.bincount(self.owners()[keep], minlength=len(self.at) - 1)
        return Slices.of_sizes(sizes, self.values[keep])


def joined(*parts: Slices) -> Slices:
    """The lists of each record one after the other."""
    sizes = np.sum([p.sizes for p in parts], axis=0)
    out = Slices.of_sizes(sizes, np.empty(int(sizes.sum()), np.int64))
    before = np.zeros(len(sizes), np.int64)
    for p in parts:
        out.values[np.repeat(out.at[:-1] + before - p.at[:-1], p.sizes) + np.arange(len(p.values))] = p.values
        before += p.sizes
    return out


def plain(values: pa.Array) -> pa.Array:
    """Lower case, accents off, every run of other characters than letters and digits one space; apostrophes vanish."""
    lower = pc.utf8_lower(pc.fill_null(values, ""))
    odd = np.flatnonzero(pc.invert(pc.match_substring_regex(lower, "^([a-z0-9]+( [a-z0-9]+)*)?$")).to_numpy(zero_copy_only=False))
    if not len(odd):
        return lower
    mask = np.zeros(len(lower), bool)
    mask[odd] = True
    return pc.replace_with_mask(lower, pa.array(mask), _plain_of_odd(lower.take(pa.array(odd))))


def _plain_of_odd(lower: pa.Array) -> pa.Array:
    v = pc.utf8_normalize(lower, "NFKD")
    v = pc.replace_substring_regex(v, r"\p{M}+", "")
    v = pc.replace_substring_regex(v, r"(\w)['’`´](\w)", r"\1\2")
    for x, y in (("ß", "ss"), ("ø", "o"), ("ł", "l")):
        v = pc.replace_substring(v, x, y)
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(v, r"[^\p{L}\p{N}]+", " "))


class Words:
    """The different words of a batch, by number."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        width = int(min(max(self.sizes, default=1), LETTERS))
        flat = np.frombuffer("".join(texts if self.sizes.max(initial=0) <= width else [t[:width] for t in texts]).encode("utf-32-le"), np.uint32)
        kept = np.minimum(self.sizes, width)
        at = np.cumsum(kept) - kept
        self.letters = np.zeros((len(texts), width + 2), np.uint32)
        self.letters[np.repeat(np.arange(len(texts)), kept), np.arange(len(flat)) - np.repeat(at, kept)] = flat
        self.first = self.letters[:, 0].astype(np.int64)
        bits = np.left_shift(np.uint64(1), (flat & 63).astype(np.uint64))
        self.mask = np.zeros(len(texts), np.uint64)
        np.bitwise_or.at(self.mask, np.repeat(np.arange(len(texts)), kept), bits)

    @cached_property
    def columns(self) -> np.ndarray:
        """The letters by their place in the word."""
        return np.ascontiguousarray(self.letters.T)

    def begin(self, n: int) -> np.ndarray:
        """A number for the first n letters (at most three)."""
        out = np.zeros(len(self.texts), np.int64)
        for k in range(n):
            out = (out << 21) | self.letters[:, k].astype(np.int64) if k < self.letters.shape[1] else out << 21
        return out


def edits(words: Words, x: np.ndarray, y: np.ndarray, cut: np.ndarray | None = None) -> np.ndarray:
    """Edit distance with transpositions of neighbours of words x and y (x not longer), 3 for all that is more than 2; cut: how many
    letters of y count."""
    order = np.argsort(-words.sizes[x], kind="stable")  # the longest first: pairs that are through drop out at the end
    x, y, la = x[order], y[order], words.sizes[x][order]
    lb = words.sizes[y] if cut is None else cut[order]
    n, far = len(x), 9
    out = np.full(n, 3, np.int8)
    before, row = np.full((5, n), far, np.int8), np.full((5, n), far, np.int8)
    row[2], row[3], row[4] = 0, 1, 2  # row i holds columns i-2 to i+2
    a, b = {}, {}  # columns of letters, by place
    k = n - int(np.searchsorted(la[::-1], 1))
    for i in range(1, int(la.max(initial=0)) + 1):
        a[i] = words.columns[i - 1][x[:k]]
        before, row, new = before[:, :k], row[:, :k], np.full((5, k), far, np.int8)
        for o in range(5):
            j = i + o - 2
            if j < 0 or j > len(words.columns):
                continue
            if j == 0:
                new[o] = i
                continue
            if j not in b:
                b[j] = words.columns[j - 1][y[:k]]
            d = row[o] + (a[i] != b[j][:k])
            if o < 4:
                d = np.minimum(d, row[o + 1] + 1)
            if o > 0:
                d = np.minimum(d, new[o - 1] + 1)
            if i > 1 and j > 1:
                turned = (a[i] == b[j - 1][:k]) & (a[i - 1][:k] == b[j][:k])
                d = np.where(turned, np.minimum(d, before[o] + 1), d)
            new[o] = d
        left = n - int(np.searchsorted(la[::-1], i + 1))
        ends = np.arange(left, k)
        place = lb[left:k] - i + 2
        fits = (place >= 0) & (place <= 4)
        out[order[ends[fits]]] = np.minimum(new[place[fits], ends[fits]], 3)
        before, row, k = row, new, left
    return out


_NICK = {w: k for k, w in enumerate(sorted({*SHORT_FORMS, *(v for f in SHORT_FORMS.values() for v in f)}))}


def _nick_table() -> np.ndarray:
    """Which given names and short forms stand for each other."""
    n = len(_NICK)
    table = np.zeros((n + 1, n + 1), bool)
    for s, full in SHORT_FORMS.items():
        for f in full:
            table[_NICK[s], _NICK[f]] = table[_NICK[f], _NICK[s]] = True
    for s, full in SHORT_FORMS.items():
        for t, other in SHORT_FORMS.items():
            if full & other:
                table[_NICK[s], _NICK[t]] = True
    return table


NICKS = _nick_table()


class Comparer:
    """How far the words of a batch can be spellings of one name."""

    def __init__(self, words: Words, established):
        self.words, self.established = words, established
        none = len(_NICK)
        self.nick = np.fromiter((_NICK.get(t, none) for t in words.texts), np.int64, len(words.texts))
        self.known = np.fromiter((t in established for t in words.texts), bool, len(words.texts))
        self.near = self._near_nicks()
        #: words that the table of short forms can say anything of
        self.short = (self.nick != none) | (self.near != none)

    def _near_nicks(self) -> np.ndarray:
        """For each word that isn't established nor in the table of short forms, a name of the table one edit away."""
        none = len(_NICK)
        near = np.full(len(self.words.texts), none, np.int64)
        rest = np.flatnonzero((self.nick == none) & ~self.known & (self.words.sizes >= 3) & (self.words.sizes <= 12))
        rest = rest[np.argsort(self.words.sizes[rest], kind="stable")]
        names = [t for t in _NICK if len(t) >= 3]
        table = Words([*names, *(self.words.texts[i] for i in rest)])
        m = len(names)
        x, y = [], []
        for k in range(m):
            low, high = m + np.searchsorted(table.sizes[m:], (table.sizes[k] - 1, table.sizes[k] + 2))
            some = low + np.flatnonzero(np.bitwise_count(table.mask[low:high] ^ table.mask[k]) <= 2)
            x.append(np.full(len(some), k))
            y.append(some)
        x, y = np.concatenate(x), np.concatenate(y)
        swap = table.sizes[x] > table.sizes[y]
        found = edits(table, np.where(swap, y, x), np.where(swap, x, y)) <= 1
        near[rest[y[found] - m]] = np.array([_NICK[t] for t in names])[x[found]]  # of several the last
        return near

    def close(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether words that begin with other letters may be spellings of one name."""
        w = self.words
        near = np.bitwise_count(w.mask[x] ^ w.mask[y]) <= 4
        some = np.flatnonzero(near)
        near[some] = np.abs(w.sizes[x[some]] - w.sizes[y[some]]) <= 2
        some = np.flatnonzero(~near & self.short[x] & self.short[y])
        x, y = x[some], y[some]
        near[some] = NICKS[self.nick[x], self.nick[y]] | NICKS[self.near[x], self.nick[y]] | NICKS[self.nick[x], self.near[y]]
        return near

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Similarity of words x and y, 0 to 1."""
        w = self.words
        out = (x == y).astype(np.float32)
        rest = np.flatnonzero(x != y)
        a, b = x[rest], y[rest]
        same = w.first[a] == w.first[b]
        same[~same] = self.close(a[~same], b[~same])
        open_ = rest[same]
        if len(open_):
            low, high = np.minimum(x[open_], y[open_]), np.maximum(x[open_], y[open_])
            each, back = np.unique(low * len(w.texts) + high, return_inverse=True)
            out[open_] = self._compared(each // len(w.texts), each % len(w.texts))[back]
        return out

    def _compared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        w = self.words
        swap = w.sizes[x] > w.sizes[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        la, lb, same = w.sizes[x], w.sizes[y], w.first[x] == w.first[y]
        score, done = np.zeros(len(x), np.float32), np.zeros(len(x), bool)

        def settle(which: np.ndarray, value) -> None:
            which = which & ~done
            score[which] = value[which] if isinstance(value, np.ndarray) else value
            done[which] = True

        settle(la == 0, 0.0)
        settle(la == 1, np.where(same, 0.6, 0.0))
        settle(NICKS[self.nick[x], self.nick[y]], 0.8)
        columns = np.arange(w.letters.shape[1])
        alike = w.letters[x] == w.letters[y]
        prefix = np.where(alike.all(axis=1), len(columns), np.argmin(alike, axis=1))
        begins = prefix >= la
        settle((la <= 3) & begins, np.where(la == 3, 0.8, 0.65))
        both = np.flatnonzero(self.known[x] & self.known[y] & ~done)
        if len(both):
            a, b, p = w.letters[x[both]], w.letters[y[both]], prefix[both]
            shifted = (a[:, :-1] == b[:, 1:]) | (columns[:-1] < p[:, None])
            letter = b[np.arange(len(both)), np.minimum(p, b.shape[1] - 1)] == b[np.arange(len(both)), np.maximum(p - 1, 0)]
            doubled = (lb[both] == la[both] + 1) & (p > 0) & letter & shifted.all(axis=1)
            other = np.zeros(len(x), bool)
            other[both[~doubled]] = True
            settle(other, 0.0)
        long = ~done & (lb > LETTERS)
        for i in np.flatnonzero(long):
            score[i] = Speller(self.established).alike(w.texts[x[i]], w.texts[y[i]])
        done |= long
        d = np.full(len(x), 3, np.int8)
        near = np.flatnonzero(~done & (lb - la <= 2) & (np.bitwise_count(w.mask[x] ^ w.mask[y]) <= 4))
        d[near] = edits(w, x[near], y[near])
        settle((lb <= 4) & (d == 2), np.where(same & (la > 2), 0.5, 0.0))
        settle((d <= 2) & (same | (d == 1) | (la >= 6)), 1 - 0.12 * d - np.where(same, 0.0, 0.1))
        settle(begins, 0.8)
        rest = np.flatnonzero(~done & (la >= 4) & (lb > la) & (prefix > 0))
        cut = np.zeros(len(x), bool)
        cut[rest] = edits(w, x[rest], y[rest], la[rest]) <= 1
        settle(cut, 0.7)
        settle(NICKS[self.near[x], self.nick[y]] | NICKS[self.nick[x], self.near[y]], 0.65)
        return score


_NO_NAME = pa.array(sorted(NO_NAME))
_DROPPED = pa.array(["", *sorted(TITLES | NO_NAME)])
_SUFFIXES = pa.array(sorted(t for t in SUFFIXES if len(t) > 1))


class Names:
    """The parsed names of the records of a batch: FIELDS as columns of text."""

    def __init__(self, columns: list[pa.Array], established=frozenset()):
        fields, flat = [], []
        for c in columns:
            d = pc.cast(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c, pa.string()).dictionary_encode()
            lists = pc.split_pattern(plain(d.dictionary), " ")
            code = np.nan_to_num(pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
            fields.append((code, np.asarray(lists.offsets).astype(np.int64), lists))
            flat.append(lists.flatten())
        every = pa.chunked_array(flat, pa.string()).combine_chunks().dictionary_encode()
        texts = every.dictionary.to_pylist()
        number = np.asarray(every.indices, np.int64) if len(every) else np.zeros(0, np.int64)
        drop = pc.is_in(every.dictionary, value_set=_DROPPED).to_numpy(zero_copy_only=False)
        suffix = pc.is_in(every.dictionary, value_set=_SUFFIXES).to_numpy(zero_copy_only=False)
        index = {t: i for i, t in enumerate(texts)}
        begin, parts, wholes = 0, [], []
        for (code, at, texts_of), words in zip(fields, flat):
            ids = number[begin : begin + len(words)]
            begin += len(words)
            base = int(at[0]) if len(at) else 0
            lists = Slices(at - base, ids)
            owner, sizes = lists.owners(), lists.sizes
            place = np.arange(len(ids)) - lists.at[:-1][owner] if len(ids) else ids
            keep = ~drop[ids] & ~(suffix[ids] & ((place > 0) | (sizes[owner] == 1)))
            missing = np.zeros(len(sizes), bool)
            several = np.flatnonzero(sizes > 1)  # a single word that is no name is left out already
            missing[several] = pc.is_in(pc.binary_join(texts_of.take(pa.array(several)), ""), value_set=_NO_NAME).to_numpy(zero_copy_only=False)
            lists = lists.where(keep & ~missing[owner])
            whole = np.full(len(lists.at), -1, np.int64)  # the last stands for NULL
            single = np.flatnonzero(lists.sizes == 1)
            whole[single] = lists.values[lists.at[single]]
            several = np.flatnonzero(lists.sizes > 1)
            if len(several):
                some = lists.take(several)
                written = pc.binary_join(pa.ListArray.from_arrays(pa.array(some.at, pa.int32()), every.dictionary.take(pa.array(some.values))), "").dictionary_encode()
                numbers = []
                for t in written.dictionary.to_pylist():
                    if t not in index:
                        index[t] = len(texts)
                        texts.append(t)
                    numbers.append(index[t])
                whole[several] = np.array(numbers, np.int64)[written.indices.to_numpy()]
            lists = Slices(np.concatenate((lists.at, lists.at[-1:])), lists.values)  # NULL has no words
            code = np.where(code < 0, len(lists.at) - 2, code)
            parts.append(lists.take(code))
            wholes.append(whole[code])
        self.words, self.established = Words(texts), established
        self.first, self.middle, self.last, self.other, self.rest = parts
        self.of_first, self.of_middle, self.of_last, self.of_other, self.of_rest = wholes
        several = [Slices.of_sizes((p.sizes > 1).astype(np.int64), w[p.sizes > 1]) for p, w in zip(parts, wholes)]
        #: all words, and the words of a field written together
        self.met = joined(self.first, self.last, self.rest, self.other, self.middle, *several)
        self.plain_last = joined(self.first, self.last, self.other)
        units = [(self.of_first, self.first), (self.of_last, self.last), (self.of_rest, self.rest)]
        self.n_units = np.sum([w >= 0 for w, _ in units], axis=0)
        self.n_words = np.sum([p.sizes for _, p in units], axis=0)
        # probes: each unit as a whole, then word by word where it has several; tag 4 * unit + (0 whole, 1 word)
        pieces, tags = [], []
        for k, (w, p) in enumerate(units):
            whole = Slices.of_sizes((w >= 0).astype(np.int64), w[w >= 0])
            single = p.where(np.repeat(p.sizes > 1, p.sizes))
            pieces += [whole, single]
            tags += [Slices(whole.at, np.full(len(whole.values), 4 * k)), Slices(single.at, np.full(len(single.values), 4 * k + 1))]
        self.probes, self.tags = joined(*pieces), joined(*tags)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last name field of each record as a word number; of a single field its first and last word."""
        first = np.where(self.of_first >= 0, self.of_first, np.where(self.of_last >= 0, self.of_last, self.of_rest))
        last = np.where(self.of_rest >= 0, self.of_rest, np.where(self.of_last >= 0, self.of_last, self.of_first))
        for p in (self.first, self.last, self.rest):
            one = np.flatnonzero((self.n_units == 1) & (p.sizes > 1))
            first[one], last[one] = p.values[p.at[one]], p.values[p.at[one + 1] - 1]
        return first, last

    @cached_property
    def letter_sets(self) -> tuple[np.ndarray, np.ndarray]:
        """Which letters the units of each record have, and which all its words have, as bits."""
        w = self.words
        mask = np.append(w.mask, np.uint64(0))
        units = mask[self.of_first] | mask[self.of_last] | mask[self.of_rest]  # -1 is the last, no letters
        met = np.zeros(len(self.n_units), np.uint64)
        np.bitwise_or.at(met, self.met.owners(), w.mask[self.met.values])
        return units, met

    def letters_fit(self, i: np.ndarray, j: np.ndarray, most: int = 3) -> np.ndarray:
        """Whether the units of one record have at most so many letters that the other hasn't at all, or full middle names begin alike."""
        units, met = self.letter_sets
        fit = (np.bitwise_count(units[i] & ~met[j]) <= most) | (np.bitwise_count(units[j] & ~met[i]) <= most)
        w = self.words
        letter = np.where((self.of_middle >= 0) & (w.sizes[self.of_middle] >= 3), w.first[self.of_middle], -1) if len(w.texts) else np.full(len(units), -1)
        return fit | (letter[i] >= 0) & (letter[i] == letter[j])

    @cached_property
    def first_letters(self) -> tuple[np.ndarray, np.ndarray]:
        """The first letters of each unit (pairs x 3) and of all words of each record, as bits."""
        w = self.words
        bit = np.append(np.left_shift(np.uint64(1), (w.first & 63).astype(np.uint64)), np.uint64(0))
        met = np.zeros(len(self.n_units), np.uint64)
        np.bitwise_or.at(met, self.met.owners(), bit[self.met.values])
        return np.stack([bit[of] for of in (self.of_first, self.of_last, self.of_rest)]), met  # -1 is the last, no letters

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """False for pairs that neither found, in one direction or the other, nor new_surnames can say anything of: a unit has no word of the
        other record that begins with its letter or is close to it."""
        out = self._units_met(i, j)
        rest = np.flatnonzero(~out)
        out[rest] = self._units_met(j[rest], i[rest])
        rest = np.flatnonzero(~out)
        if len(rest):
            size = np.append(self.words.sizes, 0)
            full = (size[self.of_first] >= 3) & (size[self.of_middle] >= 3)
            rest = rest[full[i[rest]] & full[j[rest]]]
            for of, p in ((self.of_middle, self.middle), (self.of_first, self.first)):
                a, b = i[rest], j[rest]
                may = (p.sizes[a] > 1) | (p.sizes[b] > 1) | (self.words.first[of[a]] == self.words.first[of[b]])
                may[~may] = self.comparer.close(of[a][~may], of[b][~may])
                rest = rest[may]
            out[rest] = True
        return out

    def _units_met(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether each unit of i that is one word has a word of j with its first letter or close to it."""
        letters, met = self.first_letters
        rest = np.arange(len(i))
        for bit, of, p in zip(letters, (self.of_first, self.of_last, self.of_rest), (self.first, self.last, self.rest)):
            may = ((bit[i[rest]] & ~met[j[rest]]) == 0) | (p.sizes[i[rest]] > 1)
            some = rest[~may]
            other = self.met.take(j[some])
            owner = other.owners()
            close = self.comparer.close(of[i[some]][owner], other.values)
            may[~may] = np.bincount(owner[close], minlength=len(some)) > 0
            rest = rest[may]
        out = np.zeros(len(i), bool)
        out[rest] = True
        return out

    @cached_property
    def plain_text(self) -> np.ndarray:
        """A number for each word that is the same in every batch."""
        w = self.words
        out = np.zeros(max(len(w.texts), 1), np.int64)
        for k in range(w.letters.shape[1] if len(w.texts) else 0):
            out = mixed(out, w.letters[:, k].astype(np.int64)).view(np.int64)
        for i in np.flatnonzero(w.sizes > LETTERS):  # all letters of the few that are longer
            for c in w.texts[i][LETTERS:]:
                out[i] = mixed(out[i : i + 1], ord(c)).view(np.int64)[0]
        return out

    @cached_property
    def comparer(self) -> Comparer:
        return Comparer(self.words, self.established)

    def most(self, a: Slices, i: np.ndarray, b: Slices, j: np.ndarray, fits=None) -> np.ndarray:
        """For each pair of records the greatest similarity of a word of a and one of b; fits(x, y): which word pairs count."""
        x, y, at = self._crossed(a.take(i), b.take(j))
        out = np.zeros(len(i), np.float32)
        if len(x):
            s = self.comparer.alike(x, y)
            if fits is not None:
                s = np.where(fits(x, y), s, 0)
            np.maximum.at(out, at, s)
        return out

    @staticmethod
    def _crossed(a: Slices, b: Slices) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = b.sizes[a.owners()]  # for each word of a the words of b
        x = np.repeat(a.values, sizes)
        at = np.repeat(a.owners(), sizes)
        ends = np.cumsum(sizes)
        y = b.values[np.repeat(b.at[:-1][a.owners()] - (ends - sizes), sizes) + np.arange(len(x))] if len(x) else x
        return x, y, at

    def found(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cover, unit scores of shape pairs x 3): how well each unit of record i is found among the words of j; cover is the least of
        them, 0 where one is below 0.5 or i has no two words. Units that i hasn't are NaN."""
        probes, tags, other = self.probes.take(i), self.tags.take(i), self.met.take(j)
        sizes = other.sizes[probes.owners()]
        best = np.zeros(len(probes.values), np.float32)
        x = np.repeat(probes.values, sizes)
        if len(x):
            ends = np.cumsum(sizes)
            y = other.values[np.repeat(other.at[:-1][probes.owners()] - (ends - sizes), sizes) + np.arange(len(x))]
            s = self.comparer.alike(x, y)
            some = np.flatnonzero(sizes > 0)
            best[some] = np.maximum.reduceat(s, (ends - sizes)[some])
        unit = np.full((len(i), 3), np.nan, np.float32)
        owner, kind = probes.owners(), tags.values
        whole = kind % 4 == 0
        unit[owner[whole], kind[whole] // 4] = best[whole]
        least = np.full((len(i), 3), 2.0, np.float32)
        np.minimum.at(least, (owner[~whole], kind[~whole] // 4), best[~whole])
        unit = np.where(least < 2, np.fmax(unit, least), unit)
        filled = np.where(np.isnan(unit), 2.0, unit)
        cover = filled.min(axis=1, initial=2.0)
        return np.where((cover >= 0.5) & (cover < 2) & (self.n_words[i] >= 2), cover, 0.0), unit

    def middles(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """1 if the middle names agree, 0 if one is missing, -1 if they differ; changed places with the first name count as agreeing."""
        out = np.zeros(len(i), np.int8)
        some = np.flatnonzero((self.of_middle[i] >= 0) & (self.of_middle[j] >= 0))
        a, b = i[some], j[some]
        agree = (self.of_middle[a] == self.of_middle[b]) | (self.most(self.middle, a, self.middle, b) >= 0.6)
        open_ = np.flatnonzero(~agree)
        a, b = a[open_], b[open_]
        agree[open_] = (self.most(self.middle, a, self.plain_last, b) >= 0.6) & (self.most(self.middle, b, self.plain_last, a) >= 0.6)
        out[some] = np.where(agree, 1, -1)
        return out

    def full_middles(self, i: np.ndarray, j: np.ndarray, least: float = 0.76, same_letter: bool = True) -> np.ndarray:
        """Whether two middle names of three letters or more agree (by default first letter included)."""
        w = self.words
        fits = lambda x, y: (w.sizes[x] > 2) & (w.sizes[y] > 2) & ((w.first[x] == w.first[y]) | (not same_letter))
        return self.most(self.middle, i, self.middle, j, fits) >= least

    def new_surnames(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """First and middle name in full agreement: the last name may have changed."""
        size = lambda whole: np.where(whole >= 0, self.words.sizes[whole], 0)
        out = np.zeros(len(i), bool)
        some = np.flatnonzero(np.minimum.reduce([size(self.of_first[i]), size(self.of_first[j]), size(self.of_middle[i]), size(self.of_middle[j])]) >= 3) if len(i) else np.zeros(0, np.int64)
        a, b = i[some], j[some]
        first = self.most(self.first, a, self.first, b) >= 0.7
        first[first] = self.full_middles(a[first], b[first], same_letter=False)
        out[some] = first
        return out

    def rare_shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether both have one full name, letter by letter, that isn't established."""
        w, known = self.words, self.comparer.known
        x, y, at = self._crossed(self.met.take(i), self.met.take(j))
        out = np.zeros(len(i), bool)
        out[at[(x == y) & (w.sizes[x] > 2) & ~known[x]]] = True
        return out
