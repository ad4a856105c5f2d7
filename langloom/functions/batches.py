"""Texts in batches by NumPy: sentence ends and tokens, hashes, character classes, bounded chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex

from langloom.functions import chars

SYLLABIC = "".join(f"{chr(a)}-{chr(b)}" for a, b in chars.CJK + chars.KANA + chars.HANGUL)
#: A sentence end, a syllabic character, or a run of other letters and numbers.
PARTS = regex.compile(rf"[.!?…。！？\n]|[{SYLLABIC}]|[[\p{{Alphabetic}}\p{{N}}]--[{SYLLABIC}]]+", regex.V1)
ENDS = frozenset(".!?…。！？\n")
PRIME = np.uint32(16777619)
CHUNK_CHARS, LONG_TOKEN = 1 << 19, 64


def push(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    h = (h ^ (cp & np.uint32(255))) * PRIME
    h = (h ^ ((cp >> np.uint32(8)) & np.uint32(255))) * PRIME
    return (h ^ (cp >> np.uint32(16))) * PRIME * PRIME


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = ((a * PRIME) ^ np.uint32(0x9E3779B9)) * PRIME ^ b
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def char_class(c: str) -> int:
    """As functions.chars.class_of."""
    u = ord(c)
    within = lambda ranges: any(a <= u <= b for a, b in ranges)
    if u < 128:
        return chars.LOWER if "a" <= c <= "z" else chars.UPPER if "A" <= c <= "Z" else chars.DIGIT if "0" <= c <= "9" else chars.SPACE if c in " \t\n\x0b\x0c\r" else chars.PUNCT
    script = chars.C_KANA if within(chars.KANA) else chars.C_HANGUL if within(chars.HANGUL) else chars.C_CJK if within(chars.CJK) else None
    early = chars.C_GREEK if within(chars.GREEK) else chars.C_CYRILLIC if within(chars.CYRILLIC) else script
    if regex.match(r"\p{White_Space}", c):
        return chars.SPACE
    alphabetic = bool(regex.match(r"\p{Alphabetic}", c))
    if alphabetic and regex.match(r"\p{Lowercase}", c):
        return chars.C_LATIN_EXT if within(chars.LATIN_EXT) else chars.OTHER if early is None else early
    if alphabetic and regex.match(r"\p{Uppercase}", c):
        return chars.UPPER
    if regex.match(r"\p{N}", c):
        return chars.DIGIT
    return early if early is not None else chars.OTHER if alphabetic else chars.PUNCT


OTHER_PART, END, ALNUM, SYLLABLE = range(4)
OFFSET = np.uint32(2166136261)


def part_of(c: str) -> int:
    """What a folded character is to the tokenizer."""
    if c in ENDS:
        return END
    if not PARTS.match(c):
        return OTHER_PART
    return SYLLABLE if regex.match(f"[{SYLLABIC}]", c) else ALNUM


def lay(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts with one more after each, start and length of each text)."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, np.cumsum(length + 1) - length - 1, length


def numbered(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct code points in order, the number of each one among them)."""
    seen = np.flatnonzero(np.bincount(cps))
    number = np.zeros(int(seen[-1]) + 1, np.int32)
    number[seen] = np.arange(len(seen))
    return seen.astype(np.uint32), number[cps]


def hash_rest(h: int, cps: list[int]) -> int:
    for cp in cps:
        h = ((h ^ (cp & 255)) * 16777619) & 0xFFFFFFFF
        h = ((h ^ ((cp >> 8) & 255)) * 16777619) & 0xFFFFFFFF
        h = ((h ^ (cp >> 16)) * 16777619 * 16777619) & 0xFFFFFFFF
    return h


def hash_runs(cps: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of code points (size 1 at least) and of their first four."""
    order = np.argsort(-np.minimum(size, LONG_TOKEN + 1).astype(np.int16), kind="stable")
    start, h = at[order], np.full(len(at), OFFSET)
    longer = len(at) - np.cumsum(np.bincount(np.minimum(size, LONG_TOKEN + 1), minlength=LONG_TOKEN + 2))  # than k
    first = h
    for k in range(LONG_TOKEN):
        n = int(longer[k])
        if not n:
            break
        h[:n] = push(h[:n], cps[start[:n] + k])
        if k == 3:
            first = h.copy()
    known: dict[bytes, int] = {}
    for i in range(int(longer[LONG_TOKEN])):
        run = cps[start[i] : start[i] + size[order[i]]]
        key = run.tobytes()
        if key not in known:
            known[key] = hash_rest(int(h[i]), run[LONG_TOKEN:].tolist())
        h[i] = known[key]
    out, out_first = np.empty_like(h), np.empty_like(h)
    out[order], out_first[order] = h, first
    return out, out_first


class Cut:
    """Texts, none of them empty, as arrays of what they consist of.

    ``chars`` are the distinct folded characters and ``f`` the number of each position's; the position after a text has the
    number ``len(chars)``, as has whatever ends a window. ``at``, ``size``, ``h``, ``pre``, ``suf``: the tokens' starts, lengths, hashes
    and hashes of affixes. ``item``: positions of token starts and sentence ends, a text's end among them; ``word``: which are tokens.
    """

    def __init__(self, cutter: Cutter, texts: list[str], limit: int | None):
        if any("İ" in x for x in texts):  # the only character that folds to two
            self.original = lay(texts if limit is None else [consumed(x, limit) for x in texts])
            folded, self.start, self.length = lay([x.replace("Σ", "σ").lower()[:limit] for x in texts])
            self.chars, f = numbered(folded)
        else:
            self.original = lay(texts if limit is None else [x[:limit] for x in texts])
            folded, self.start, self.length = self.original
            seen, f = numbered(folded)
            self.chars, to = np.unique(np.fromiter((ord(chr(c).lower()) for c in seen.tolist()), np.uint32, len(seen)), return_inverse=True)
            f = to.astype(np.int32)[f]
        self.none = len(self.chars)
        f[self.start + self.length] = self.none
        self.f = f
        part = np.append(cutter.parts(self.chars), np.uint8(END))[f]
        alnum, one = part == ALNUM, part == SYLLABLE
        begin, last = alnum.copy(), alnum.copy()
        begin[1:] &= ~alnum[:-1]
        last[:-1] &= ~alnum[1:]
        begin |= one
        self.at = np.flatnonzero(begin)
        self.size = np.flatnonzero(last | one) + 1 - self.at
        self.item = np.flatnonzero(begin | (part == END))
        self.word = part[self.item] != END
        cps = np.append(self.chars, np.uint32(0))[f]
        self.h, self.pre = hash_runs(cps, self.at, self.size)
        self.head = np.minimum(self.size, 8)
        self.suf = self.pre.copy()
        long = np.flatnonzero(self.size > 4)
        from_ = self.at[long] + self.head[long] - 4
        h = np.full(len(long), OFFSET)
        for k in range(4):
            h = push(h, cps[from_ + k])
        self.suf[long] = h

    def pairs(self) -> np.ndarray:
        """Numbers of the tokens that have one before them in their sentence."""
        return (np.cumsum(self.word) - 1)[1:][self.word[1:] & self.word[:-1]]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(position of the end, number of tokens) of each sentence that has any."""
        stop = np.flatnonzero(~self.word)
        run = np.diff(np.append(-1, stop)) - 1
        return self.item[stop[run > 0]], run[run > 0]

    def windows(self, limit: int | None = None, inverse: bool = False) -> tuple[np.ndarray, ...]:
        """Distinct windows of three characters, as three arrays of numbers, with their counts or, at each position, their number.

        Of the first ``limit`` characters of each text.
        """
        f, size = self.f.astype(np.int64), self.none + 1
        for i in np.flatnonzero(self.length > limit).tolist() if limit else ():
            f[self.start[i] + limit : self.start[i] + self.length[i]] = self.none
        f = np.append(f, [self.none] * 2)
        code = (f[:-2] * size + f[1:-1]) * size + f[2:]
        if size**3 <= max(4 * len(code), 1 << 16):
            counts = np.bincount(code)
            found = np.flatnonzero(counts)
            counts = counts[found]
            if inverse:
                number = np.zeros(int(found[-1]) + 1, np.int32)
                number[found] = np.arange(len(found))
                counts = number[code]
        elif inverse:
            found, counts = np.unique(code, return_inverse=True)
        else:
            found, counts = np.unique(code, return_counts=True)
        return found // size**2, found // size % size, found % size, counts

    def hashes(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the first two and of all three characters of windows."""
        cps = np.append(self.chars, np.uint32(0))
        two = push(push(np.full(len(cps), OFFSET), cps)[a], cps[b])
        return two, push(two, cps[c])


class Cutter:
    """Cuts texts; what it has learnt of characters stays."""

    def __init__(self):
        self.known = {part_of: np.full(0x110000, 255, np.uint8), char_class: np.full(0x110000, 255, np.uint8)}

    def _of(self, cps: np.ndarray, what) -> np.ndarray:
        table = self.known[what]
        for cp in cps[table[cps] == 255].tolist():
            table[cp] = what(chr(cp))
        return table[cps]

    def parts(self, chars: np.ndarray) -> np.ndarray:
        return self._of(chars, part_of)

    def classes(self, chars: np.ndarray) -> np.ndarray:
        return self._of(chars, char_class)

    def cut(self, texts: list[str], limit: int | None = None) -> Cut:
        return Cut(self, texts, limit)


def consumed(text: str, limit: int) -> str:
    """The original characters that the first ``limit`` folded ones come from: only İ folds to two."""
    if "İ" not in text:
        return text[:limit]
    return text.replace("İ", "İ﷑")[:limit].replace("﷑", "")


def chunked_sizes(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of neighbours that have ``CHUNK_CHARS`` together at most, or are one."""
    i, now = 0, 0
    for j, n in enumerate(sizes):
        if j > i and now + n > CHUNK_CHARS:
            yield i, j
            i, now = j, 0
        now += n
    if i < len(sizes):
        yield i, len(sizes)

