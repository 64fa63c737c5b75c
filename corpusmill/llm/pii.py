"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (``base_spans``) find what is certain. The field is trained on the small labelled table
``LABELLED`` by gradient ascent on its regularized likelihood and labels each word of a text as outside
or as the start or inside of a span; a word's features are its shape (letters, lengths of digit runs, marks) and
those of its neighbours. Texts are decoded by Viterbi in numpy batches. Where a word prefers "outside" by more
than any change of its two transitions can outweigh, the best path is outside there; such words
cut the chain, which changes no result, and only the pieces between them are decoded, padded together.

Spans of the field that touch no span of the patterns are added to theirs.

Cases: null text counts as empty: no spans. Offsets are code points, end exclusive. A span of the field starts
and ends without the punctuation around its words. Repeated rows each keep their spans. Other
columns are not carried. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import own

KINDS = ("email", "ip", "card", "phone")

#: Labelled sentences: [kind text] is a span.
LABELLED = """
please write to [email anna.lind@mail.example.org] for a copy
Contact: [email j_doe99@uni.example.edu] or the desk
my address is [email info@shop.example] and hers is [email b.c@d.example.com].
Mail [email support+help@service.example.net] today
he signed as [email k.42@box7.example.com] in the list
reach me: [email first(at)example(dot)org] any day
reach them: [email last.one(at)mail.example(dot)com] soon
the server at [ip 10.0.0.12] did not answer
Connections from [ip 192.168.1.254] were refused by [ip 172.16.0.1].
a host [ip 8.8.4.4] is up
the log shows [ip 203.0.113.77] twice, then [ip 198.51.100.3]
It came from [ip 129.38.82.176] that day
her card is [card 4111111111111111] she said
He paid with [card 5500005555555559] and left
the number [card 3782822463100050] was read out
card [card 4111 1111 1111 1111] expires soon
use [card 5500 0055 5555 5559] for this
number [card 4012-8888-8888-1881] on file
the of [card 7536784127813050] [card 4845168114407329] and then on
The words [card 9777946427004852] at the end
number [card 36070500001020] or [card 378282246310005] was used
call [phone +1 (415) 555-2671] before noon
Phone: [phone +44 20 7946 0958] or write
ring [phone +49 30 901820] or [phone +33 1 70 18 99 00] at once
My number is [phone +1 (487) 555-7209] and that is it
dial [phone (212) 555-0187] now
dial [phone 212-555-0187] now
her phone [phone 020 7946 0958] is off
try [phone 555-123-4567], then wait
on [phone +1 (017) 555-7713] thing
[phone +1 (974) 555-3436] that is the one
[ip 56.187.231.175] is it
[card 0810992847249404] that is the one
[email a.b@c.example.com] that is the one
It was a plain day and nothing was said of it.
The report of 2019 had 12 pages and 3 tables.
In 1998 and 2004, the rule changed in 27 states.
Version 2.0. of the program, and 3.14 of the other
Licensed under the Apache License, Version 2.0.
the key "3f9a77c01b2d4e5f60718293a4b5c6d7" is kept safe
the token "a99b12c45d9e8f7a6b5c4d3e2f1a0b9c8d7e6f5a" was set
a price of 1,299.00 or 15% less
at 10:30 on 12/05/2021 we met in room 204
On 2021-05-12 it rained, on 2021-06-01 it did not
section 4.2.1 and item 7 of list 12
THE WHOLE LINE IS LOUD!! VERY LOUD!! INDEED!!
words%%% with*** marks### after$$$ them&&& all
one | two | Three | four, | five | six.
It is. The end. Of it all, and of them. Be there
Été comme hiver, les uns et les autres y vont.
Über die Brücke ging es nach Hause, und zwar schnell.
¿Qué pasa? Nada, dijo el otro.
see https://www.example.org/a/b?c=1 for more
Copyright 2001-2015 by the authors. All rights reserved.
a ratio of 1:2, a score of 3-2 and a temperature of -5
ISBN 978-3-16-148410-0 in the catalogue
part no. 12345 and lot 998877 of batch 20210512
the sum of 100000 or 1000000 in all
A B C and I saw X at the O
it's a well-known fact, isn't it; so they say
"Quoted words" (and others) [in brackets] - with a dash
e-mail and the @ sign are common; so is + and a lone ( too
Reply (at) your own pace (dot) said he
Word.Word.Word and so.on and so.forth
In the end, of course, it was, as they said, a long, cold, and dark way. Then, at last, came the day.
Von hier aus, so heißt es, ist es weit, und der Weg, der lange, ist schwer. Und dann, am Ende, kam er.
Para ello, como se sabe, hay que ir, y no es poco, a la casa, que está lejos. Los otros, en fin, no van.
Les uns, les autres, tous, et ceux qui restent, sont là, dit-on. On ne sait, pourtant, ni où, ni quand.
he and she and it and they and we and you and all of us went on and on and on and on
Again Again Again Again again. again. again. again.
"""

TAIL = "!?,.;:%$#*&|\"'>)]}"
HEAD = "\"'<[{"
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS = re.compile(r"\S+")


def _run(m: re.Match) -> str:
    n = len(m.group())
    return "9" * n if n <= 4 else "5" if n <= 8 else "8" if n <= 11 else "2" if n <= 13 else "6" if n <= 19 else "0"


def core(word: str) -> tuple[int, int]:
    """Where the word begins and ends without the punctuation around it; brackets that belong together stay."""
    lo, hi = 0, len(word)
    while lo < hi and word[lo] in HEAD:
        lo += 1
    while hi > lo and word[hi - 1] in TAIL and not (word[hi - 1] == ")" and word[lo] == "(" and word.find(")", lo) == hi - 1):
        hi -= 1
    return (lo, hi) if hi > lo else (0, len(word))


def shape(word: str) -> str:
    """Letters become a, A or Aa, digit runs their length or a class of lengths; marks stay, up to three in a row."""
    lo, hi = core(word)
    w = word[lo:hi]
    if w.isalpha():
        kind = "a" if w.islower() else "A" if w.isupper() else "Aa" if w[0].isupper() and w[1:].islower() else "aA"
        return kind + ("" if hi == len(word) else ".")
    w = _LETTERS.sub(lambda m: "a" if m.group() not in ("at", "dot") else m.group(), w)
    w = _DIGITS.sub(_run, w)
    w = re.sub(r"(a[.\-_]?)+a", "a", w)
    w = re.sub(r"([^\w\s])\1{3,}", r"\1\1\1", w)
    return w if len(w) <= 40 else "long:" + re.sub(r"[^@+]", "", w)[:3]


def marks(s: str) -> list[str]:
    """Coarse features of a shape, which unseen shapes share."""
    digits = any(c in "958260" for c in s)
    out = ["digits" if digits else "none"]
    if "@" in s and re.search(r"[a9582]@[a9582].*\.?", s):
        out.append("address")
    if re.fullmatch(r"9{1,3}(\.9{1,3}){3}", s):
        out.append("quad")
    if re.fullmatch(r"\+?[(9][-().9582]*", s) and digits:
        out.append("groups")
    if s[:1] == "+":
        out.append("plus")
    if s == "6":
        out.append("long run")
    if digits and "a" in s:
        out.append("mixed")
    return out


def parse(labelled: str) -> list[tuple[list[str], list[int]]]:
    out = []
    for line in labelled.strip().split("\n"):
        words, labels = [], []
        for part in re.split(r"(\[(?:email|ip|card|phone) [^\[\]]*\])", line):
            m = re.fullmatch(r"\[(email|ip|card|phone) (.*)\]", part)
            if m and words and not re.search(r"\s$", before):
                raise ValueError(f"a span must start a word: {line}")
            for i, w in enumerate((m[2] if m else part).split()):
                if not m and i == 0 and words and part[0] not in " \t":  # punctuation behind a span
                    words[-1] += w
                    continue
                words.append(w)
                labels.append(LABELS.index(f"{'I' if i else 'B'}-{m[1]}") if m else 0)
            before = part
        out.append((words, labels))
    return out


class Field:
    """The conditional random field: weights of features by label, and of transitions."""

    def __init__(self, labelled: str = LABELLED, steps: int = 300, rate: float = 0.15, ridge: float = 0.02):
        data = parse(labelled)
        shapes = {"": 0}  # 0: beyond the text
        for words, _ in data:
            for w in words:
                shapes.setdefault(shape(w), len(shapes))
        names = sorted({m for s in shapes for m in marks(s)})
        self.names = {m: i for i, m in enumerate(names)}
        self.known = shapes
        k, n = len(LABELS), len(data)
        t = max(len(w) for w, _ in data)
        x = np.zeros((n, t + 2), np.int64)
        y = np.zeros((n, t), np.int64)
        live = np.zeros((n, t), bool)
        for i, (words, labels) in enumerate(data):
            x[i, 1 : len(words) + 1] = [shapes[shape(w)] for w in words]
            y[i, : len(words)] = labels
            live[i, : len(words)] = True
        own_ = np.zeros((len(shapes), len(shapes) + len(names)))
        for s, j in shapes.items():
            own_[j, j] = 1
            for m in marks(s) if j else ():
                own_[j, len(shapes) + self.names[m]] = 1
        f = own_.shape[1]
        self.w = np.zeros((3, f, k))  # own, previous, next
        self.t = np.zeros((k + 1, k + 1))  # row k: the start; column k: the end
        params = [self.w, self.t]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        feats = [own_[x[:, 1:-1]], own_[x[:, :-2]], own_[x[:, 2:]]]
        for step in range(1, steps + 1):
            e = sum(a @ w for a, w in zip(feats, self.w))
            unary, pairs = self._expected(e, live)
            want_u = np.eye(k)[y] * live[..., None]
            want_p = np.zeros_like(self.t)
            for i in range(n):
                z = [k, *y[i][live[i]], k]
                np.add.at(want_p, (z[:-1], z[1:]), 1)
            d = (want_u - unary).reshape(-1, k)
            grads = [np.stack([a.reshape(-1, f).T @ d for a in feats]) - ridge * self.w, want_p - pairs - ridge * self.t]
            for p, g, a, b in zip(params, grads, m1, m2):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.rows: list[np.ndarray] = []
        self.ids: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self._row("")
        self.spread = self._spread()

    def _expected(self, e: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels and transitions by forward and backward sums, all sentences at once."""
        n, t, k = e.shape
        tr = self.t[:k, :k]
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        fw = np.zeros_like(e)
        bw = np.zeros_like(e)
        fw[:, 0] = self.t[k, :k] + e[:, 0]
        for i in range(1, t):
            fw[:, i] = np.where(live[:, i, None], lse(fw[:, i - 1, :, None] + tr, 1) + e[:, i], fw[:, i - 1])
        bw[:, -1] = self.t[:k, k]
        for i in range(t - 2, -1, -1):
            bw[:, i] = np.where(live[:, i + 1, None], lse(tr + (e[:, i + 1] + bw[:, i + 1])[:, None, :], 2), self.t[:k, k])
        z = lse(fw[:, -1] + self.t[:k, k], 1)
        unary = np.exp(fw + bw - z[:, None, None]) * live[..., None]
        pairs = np.zeros_like(self.t)
        pairs[k, :k] = unary[:, 0].sum(0)
        last = live.sum(1) - 1
        pairs[:k, k] = unary[np.arange(n), last].sum(0)
        for i in range(1, t):
            p = np.exp(fw[:, i - 1, :, None] + tr + (e[:, i] + bw[:, i])[:, None, :] - z[:, None, None])
            pairs[:k, :k] += p[live[:, i]].sum(0)
        return unary, pairs

    def _row(self, s: str) -> int:
        """The number of a shape; its three emission vectors are computed once."""
        i = self.ids.get(s)
        if i is None:
            f = np.zeros(self.w.shape[1])
            if s in self.known:
                f[self.known[s]] = 1
            for m in marks(s) if s else ():
                if m in self.names:
                    f[len(self.known) + self.names[m]] = 1
            i = self.ids[s] = len(self.rows)
            self.rows.append(np.einsum("f,cfk->ck", f, self.w))
        return i

    def _spread(self) -> float:
        """The most that the two transitions at a word can lose by turning its label into outside."""
        k = len(LABELS)
        into = (self.t[:, :k] - self.t[:, :1]).max()
        out = (self.t[:k] - self.t[:1]).max()
        return float(into + out)

    def numbers(self, words: list[str]) -> list[int]:
        known = self.words
        if new := set(words).difference(known):
            if len(known) > 200_000:
                known.clear()
                new = set(words)
            if len(self.ids) > 200_000:
                self.ids, self.rows = {}, []
                self._row("")
                known.clear()
                new = set(words)
            known.update({w: self._row(shape(w)) for w in new})
        return [known[w] for w in words]

    def decode(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int]]:
        """(text, word, label) of every word that isn't outside."""
        k = len(LABELS)
        # per word: its shape, with one 0 before the first text and after each
        lists = [self.numbers(w) for w in texts]
        if len(set(map(len, lists))) == 1 and not lists[0]:
            return
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.zeros(int(sizes.sum()) + len(lists) + 1, np.int64)
        at = np.cumsum(sizes + 1) - sizes  # of each text's first word
        for a, x in zip(at.tolist(), lists):
            ids[a : a + len(x)] = x
        table = np.stack(self.rows)
        real = np.flatnonzero(ids > 0)
        # distinct neighbourhoods are few: one emission for each
        trip = (ids[real - 1] * len(table) + ids[real]) * len(table) + ids[real + 1]
        kinds, which = np.unique(trip, return_inverse=True)
        a, b, c = kinds // len(table) // len(table), kinds // len(table) % len(table), kinds % len(table)
        e = table[b, 0] + table[a, 1] + table[c, 2]
        open_ = (e[:, 0] - e[:, 1:].max(1) <= self.spread)[which]
        if not open_.any():
            return
        flag = np.zeros(len(ids), bool)
        flag[real[open_]] = True
        emit = np.zeros(len(ids), np.int64)
        emit[real] = which
        edge = np.diff(np.concatenate([[0], flag.view(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        order = np.argsort(hi - lo, kind="stable")[::-1]
        lo, n = lo[order], (hi - lo)[order]
        first = np.where(ids[lo - 1] == 0, k, 0)
        score = self.t[first, :k] + e[emit[lo]]
        back = []
        for i in range(1, int(n[0])):
            m = int(np.searchsorted(-n, -i, side="left"))  # pieces longer than i
            cand = score[:m, :, None] + self.t[:k, :k]
            back.append(cand.argmax(1).astype(np.int8))
            score[:m] = cand.max(1) + e[emit[lo[:m] + i]]
        label = (score + self.t[:k, np.where(ids[lo + n] == 0, k, 0)].T).argmax(1)
        found = []
        for i in range(int(n[0]) - 1, -1, -1):
            m = int(np.searchsorted(-n, -i, side="left"))
            hit = np.flatnonzero(label[:m])
            found += zip((lo[hit] + i).tolist(), label[hit].tolist())
            if i:
                label[:m] = back[i - 1][np.arange(m), label[:m]]
        for place, x in sorted(found):
            t = int(np.searchsorted(at, place, side="right")) - 1
            yield t, place - int(at[t]), x


@functools.cache
def trained() -> Field:
    return Field()


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# A start inside a run of digits fits only where the run's start does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((2 * d - 9 if d > 4 else 2 * d) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, position of the kind in KINDS, end) by the fixed patterns, in order."""
    out = []
    at, lo = text.find("@"), 0
    while at >= 0:
        start = at
        while start > lo and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            lo = m.end()
            at = text.find("@", lo)
        else:
            lo = at + 1
            at = text.find("@", lo)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def find(texts: list[str], crf: Field) -> list[tuple[list, list]]:
    """Per text the spans of the patterns and those that the field adds, as (start, kind, end)."""
    base = [base_spans(t) for t in texts]
    words = [t.split() for t in texts]
    added: list[list] = [[] for _ in texts]
    seen: dict[int, list[tuple[int, int]]] = {}
    last = (-1, -1, -1)
    for t, i, label in crf.decode(words):
        if t not in seen:
            seen[t] = [m.span() for m in _WORDS.finditer(texts[t])]
        a, b = seen[t][i]
        lo, hi = core(texts[t][a:b])
        kind, inside = (label - 1) // 2, label % 2 == 0
        if inside and last == (t, i - 1, kind):
            added[t][-1] = (added[t][-1][0], kind, a + hi)
        else:  # an inside label with no span before it starts one
            added[t].append((a + lo, kind, a + hi))
        last = (t, i, kind)
    return [(b, [s for s in x if not any(s[0] < y[2] and y[0] < s[2] for y in b)] if b else x) for b, x in zip(base, added)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): counts by pattern, digest of their spans, all spans, how many the field added."""
    # trained once, on the driver; its weights are a few hundred rows
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            rows, lo, size = [], 0, 0
            for i, t in enumerate([*texts, None]):
                if t is None or size > 2_000_000:
                    rows += find(texts[lo:i], sent.value)
                    lo, size = i, 0
                size += len(t or "")
            out = {"doc_id": b["doc_id"]}
            for j, k in enumerate(KINDS):
                out[f"n_{k}"] = [sum(s[1] == j for s in x) for x, _ in rows]
            out["base_sha256"] = [hashlib.sha256(joined(x).encode()).hexdigest() for x, _ in rows]
            out["spans"] = [joined(x + y) for x, y in rows]
            out["n_added"] = [len(y) for _, y in rows]
            yield pd.DataFrame(out)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return own(docs, "doc_id", "text").mapInPandas(run, schema)
