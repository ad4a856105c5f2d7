"""A plain-Python version of counting, model building and scoring, to hold results against."""

import math
import unicodedata
from collections import Counter

import numpy as np
import regex

F32 = np.float32
SYL = regex.compile("[一-鿿㐀-䶿\U00020000-\U0002a6df豈-﫿぀-ヿ가-힯ᄀ-ᇿ㄰-㆏]")
ALPHA, LOWER, UPPER, WHITE = (regex.compile(rf"\p{{{p}}}") for p in ("Alphabetic", "Lowercase", "Uppercase", "White_Space"))
ENDS = set(".!?…。！？\n")


def fnv(cps):
    h = 0x811C9DC5
    for cp in cps:
        for b in cp.to_bytes(4, "little"):
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def mix(a, b):
    m = 0xFFFFFFFF
    h = (a * 0x01000193 & m) ^ 0x9E3779B9
    h = (h * 0x01000193 & m) ^ b
    h ^= h >> 15
    h = h * 0x85EBCA6B & m
    return h ^ (h >> 13)


def number(c):
    return unicodedata.category(c)[0] == "N"


def cls(c):
    u = ord(c)
    within = lambda *r: any(a <= u <= b for a, b in r)
    if u < 128:
        return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\n\x0b\x0c\r" else 4
    if WHITE.match(c):
        return 3
    greek, cyr = within((0x370, 0x3FF), (0x1F00, 0x1FFF)), within((0x400, 0x52F))
    kana, hangul, cjk = within((0x3040, 0x30FF)), within((0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F)), within((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0xF900, 0xFAFF))
    if ALPHA.match(c) and LOWER.match(c):
        return 5 if within((0xC0, 0x24F), (0x1E00, 0x1EFF)) else 6 if greek else 7 if cyr else 9 if kana else 10 if hangul else 8 if cjk else 11
    if ALPHA.match(c) and UPPER.match(c):
        return 1
    if number(c):
        return 2
    return 6 if greek else 7 if cyr else 9 if kana else 10 if hangul else 8 if cjk else 11 if ALPHA.match(c) else 4


def fold(text):
    return "".join(c.lower() for c in text)


def sentences(folded):
    out, run, sent = [], "", []

    def flush():
        nonlocal run
        if run:
            sent.append(run)
        run = ""

    for c in folded:
        if c in ENDS:
            flush()
            if sent:
                out.append(sent)
            sent = []
        elif SYL.match(c):
            flush()
            sent.append(c)
        elif ("a" <= c <= "z" or "0" <= c <= "9") if ord(c) < 128 else (ALPHA.match(c) or number(c)):
            run += c
        else:
            flush()
    flush()
    if sent:
        out.append(sent)
    return out


def key(token):
    return fnv(map(ord, token))


def qlog(p):
    x = float(F32(math.log(float(F32(p))))) * 4096
    return int(max(-32768, min(32767, math.copysign(math.floor(abs(x) + 0.5), x))))


def qprob(p):
    return int(math.floor(float(F32(max(0.0, min(1.0, float(p)))) * F32(65535)) + 0.5))


def div(a, b):
    return F32(F32(a) / F32(b))


class Lang:
    def __init__(self):
        self.maps = {s: Counter() for s in range(11)}
        self.docs = 0

    def ingest(self, text):
        if not text:
            return
        self.docs += 1
        f = fold(text)
        cps = [ord(c) for c in f]
        m = self.maps
        m[0].update(cps)
        m[1].update(fnv(cps[i : i + 2]) for i in range(len(cps) - 1))
        m[2].update(fnv(cps[i : i + 3]) for i in range(len(cps) - 2))
        kinds = [cls(c) for c in text]
        m[10].update(zip(kinds, kinds[1:], strict=False))
        for sent in sentences(f):
            m[6][min(len(sent), 63)] += 1
            for i, t in enumerate(sent):
                m[3][key(t)] += 1
                m[5][min(len(t), 31)] += 1
                if i:
                    m[4][mix(key(sent[i - 1]), key(t))] += 1
                a = t[:8]
                if len(a) >= 2:
                    m[7][key(a[:4])] += 1
                    m[8][key(a[-4:])] += 1
                    m[9][ord(a[0]), 0] += 1
                    m[9][ord(a[-1]), 2] += 1
                    m[9].update((ord(c), 1) for c in a[1:-1])

    def build(self, idf):
        k = {0: 512, 1: 6000, 2: 12000, 3: 6000, 4: 3000, 7: 1024, 8: 1024}
        total = {s: max(1, sum(m.values())) for s, m in self.maps.items()}
        top = {s: sorted(self.maps[s].items(), key=lambda x: (-x[1], x[0]))[:n] for s, n in k.items()}
        self.q = {s: {a: qlog(div(F32(c) + F32(0.5), F32(total[s]) + F32(0.5))) for a, c in rows} for s, rows in top.items()}
        self.oov = qlog(div(F32(0.5), F32(total[2]) + F32(0.5)))
        self.idf = {a: int(math.floor(float(idf.get(a, 0)) * 1024 + 0.5)) for a, _ in top[3]}
        self.hist = {s: [qprob(div(self.maps[s][b], total[s])) for b in range(n)] for s, n in ((5, 32), (6, 64))}
        self.rank = {a: i for i, a in enumerate(sorted(self.q[0]))}
        chars = sorted(a for a, _ in sorted(self.maps[0].items(), key=lambda x: (-x[1], x[0]))[:256])
        self.pos = [[qlog(div(F32(self.maps[9][c, s]) + F32(0.5), F32(self.maps[0][c]) + F32(1.5))) for s in range(3)] for c in chars]
        self.cls = {}
        for a in range(12):
            row = max(1, sum(self.maps[10][a, b] for b in range(12)))
            self.cls.update({(a, b): qprob(div(F32(self.maps[10][a, b]) + F32(0.5), F32(row) + F32(0.5))) for b in range(12)})

    def place(self, c, slot):
        i = self.rank.get(ord(c))
        return self.oov if i is None or i >= len(self.pos) else self.pos[i][slot]

    def score(self, text):
        f = fold(text)[:32768]
        if not f:
            return -math.inf
        cps, n = [ord(c) for c in f], len(f)
        g = lambda s, a: self.q[s].get(a, self.oov)
        avg = lambda s, c: s / (c * 4096.0) if c else 0.0
        uni = sum(g(0, c) for c in cps)
        bi = sum(g(1, fnv(cps[i : i + 2])) for i in range(n - 1))
        tri = sum(g(2, fnv(cps[i : i + 3])) for i in range(n - 2))
        tok = tb = pos = 0.0
        nt = nb = npos = wl = sl = ns = 0
        for sent in sentences(fold(text)):
            ns += 1
            sl += self.hist[6][min(len(sent), 63)]
            for i, t in enumerate(sent):
                nt += 1
                wl += self.hist[5][min(len(t), 31)]
                tok += g(3, key(t)) * (1 + 0.25 * self.idf.get(key(t), 0) / 1024)
                if i:
                    tb += g(4, mix(key(sent[i - 1]), key(t)))
                    nb += 1
                a = t[:8]
                if len(a) >= 2:
                    tok += 0.2 * g(7, key(a[:4])) + 0.2 * g(8, key(a[-4:]))
                    pos += self.place(a[0], 0) + self.place(a[-1], 2)
                    npos += 2
        kinds = [cls(c) for c in f]
        pairs = sum(self.cls[p] for p in zip(kinds, kinds[1:], strict=False))
        w = (0.55, 0.30, 0.05) if n < 150 else (0.45, 0.25, 0.15)
        dist = math.log(max(wl / (65535 * nt) if nt else 0, 1e-6)) + math.log(max(sl / (65535 * ns) if ns else 0, 1e-6))
        return avg(tri, max(0, n - 2)) * w[0] + avg(bi, n - 1) * w[1] + avg(uni, n) * 0.05 + avg(tok, max(nt, 1)) * w[2] + avg(tb, nb) * 0.05 + avg(pos, npos) * 0.03 + avg(pairs, n - 1) * 0.02 + dist * 0.05


class Plain:
    def __init__(self, langs):
        self.langs = langs

    def classify(self, text):
        rows = sorted(((lang, e.score(text)) for lang, e in self.langs.items()), key=lambda x: -x[1])
        best = rows[0][1]
        if best == -math.inf:
            return [(lang, s, 0.0) for lang, s in rows]
        e = [math.exp(max(-20.0, (s - best) / 0.15)) for _, s in rows]
        return [(lang, s, x / sum(e)) for (lang, s), x in zip(rows, e, strict=True)]


def train_plain(rows):
    langs = {code: Lang() for code in sorted({r[0] for r in rows})}
    for code, text in rows:
        langs[code].ingest(text)
    df = Counter(k for e in langs.values() for k in e.maps[3])
    n = len(langs)
    idf = {k: F32(math.log((n - d + 0.5) / (d + 0.5) + 1)) for k, d in df.items()}
    for e in langs.values():
        e.build(idf)
    return Plain(langs)
