"""Problem 9: posts made of search phrases, links, tags or product names instead of sentences.

A post's own words are taken first: quotes (bracket, blockquote, ``>`` and ``|`` styles with their headers) and the signature
are left aside, markup is removed, compatibility forms, invisible characters and run-together tags are resolved, digits made
alike. Then a suffix automaton over the characters of the post finds its maximal repeats of at least ``LEAST_REPEAT``
characters, the share of the text that they cover, and the share of its letters in the occurrences of the most repeated
phrase. The automaton is built over the stretches in which every run of ``LEAST_REPEAT`` characters occurs again somewhere in
the post: all such repeats lie in them whole, so nothing is lost, and ordinary posts have little of them.

Where these stretches, which bound what an automaton can find, are too few to make the post spam, the automaton is spared.

Covered text is judged by its clauses, in any language: what share of its letters stands outside of anything set like a
sentence (a beginning that is no small letter, an end mark, words in between). A post is spam if repeats cover it and most of
it is outside of sentences, or if one phrase over and over makes up about half of it, sentences or not. Each text is judged
alone and whole, in close to linear time.

Defined cases: NULL, empty and blank text, and posts of fewer than ``LEAST_LETTERS`` own letters, are none; a very long text
is processed whole; repeated rows are judged alike; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import spread

#: Characters of a repeat, at least.
LEAST_REPEAT = 6
#: Own letters below which a post is too short to repeat anything: a one-line reply.
LEAST_LETTERS = 30
#: Shares of a spam post: of the text in repeats; that and the share of letters outside sentences together ...
COVERED, TOGETHER = 0.2, 1.2
#: ... or of the letters in one phrase that occurs ``OFTEN`` times, in a text covered to this share.
PHRASE, PHRASE_COVERED, OFTEN = 0.48, 0.5, 4

_QUOTE_TAG = re.compile(r"\[(quote|QUOTE)[^\]]{0,200}\]|\[/(quote|QUOTE)\]")
_BLOCK = re.compile(r"<blockquote[^>]*>|</blockquote>", re.I)
#: A quoted line, or a code block with its end that starts outside quoted lines; one that starts anew before its end has none.
_QUOTED_OR_CODE = re.compile(r"^[^\S\n]*[>|][^\n]*|\[code\](?:(?!\[code\]).)*?\[/code\]|<pre\b[^>]*>(?:(?!<pre\b).)*?</pre>|```.*?```", re.S | re.I | re.M)
_CODE_START = re.compile(r"\[code\]|<pre\b[^>]*>|```", re.I)
#: What lines of a code block without an end look like: a time or date first, name=value, an assignment, brackets of a program.
_CODE_LINE = re.compile(r"^\W*(?:\d{1,2}:\d{2}|\d{4}-\d{2}-\d{2})|\w(?:[-+!:<>=]?=|->|::)|^\s*[\w.]+ [-+*/:]?= \S|^\s*[{}]|[({].*[;{]\s*$")
_BREAK = re.compile(r"<br\s*/?>|</?p>|</?div>|</?li>|</?ul>|</?ol>", re.I)
_WROTE = re.compile(r"^\W*(?:On\s.{3,40},\s)?\S{2,40}\s+(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.I)
_SIGNATURE = re.compile(r"^\s*(?:-- ?|—|__+|~~+|==+|\*\s?\*\s?\*|\[size=1\].*)\s*$")
_SIGNATURE_STARTS = "-—_~=*["
_LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
_TAG = re.compile(r"\[/?(?:b|i|u|url|img|size|color|list|\*|code|center|font)[^\]]*\]|<[^<>]{1,300}>", re.I)
_HREF = re.compile(r"""(?:href\s*=\s*['"]?|\[url=|\]\()\s*((?:https?://|www\.)[^\s'">\])]+)""", re.I)
_ENTITY = {"&gt;": ">", "&lt;": "<", "&amp;": "&", "&nbsp;": " ", "&quot;": '"', "&#39;": "'"}
_INVISIBLE = regex.compile(r"\p{Cf}+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = regex.compile(r"[\p{L}\p{N}@][\p{L}\p{M}\p{N}@]*(?:['’][\p{L}\p{M}]+)*")
#: The same for text of ASCII alone.
_ASCII_WORD = re.compile(r"[A-Za-z0-9@]+(?:'[A-Za-z]+)*")
_SEGMENT = re.compile(r"([.!?।|•·/]+)(?=\s|$)|([。！？؟]+)|\s[-–—/|•·*+>]+\s|[\n\r|•·]+")
_ENDS = frozenset(".!?।。！？؟")
#: The Greek question mark.
_GREEK = re.compile(r"(?<=[\u0370-\u03ff\u1f00-\u1fff]);")
_STRETCHED = re.compile(r"(.)\1{3,}", re.S)
_BLANK = re.compile(r"[\s_+]+|%20")
_DIGIT = re.compile(r"\d")
_ALIKE = str.maketrans("123456789", "0" * 9)
#: Letters of scripts without spaces.
_NO_SPACE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]")


def own_text(text: str) -> str:
    """The text without quoted parts, log excerpts and the signature, in plain form."""
    t = text
    if "&" in t:
        for k, v in _ENTITY.items():
            t = t.replace(k, v)
    if not t.isascii():
        t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", t))
    for pattern in (_QUOTE_TAG, _BLOCK):
        out, depth, at = [], 0, 0
        for m in pattern.finditer(t):
            if depth == 0:
                out.append(t[at : m.start()])
            closes = m.group().startswith(("[/", "</"))
            depth = max(0, depth - 1) if closes else depth + 1
            at = m.end()
        if depth == 0:
            out.append(t[at:])
        elif not "".join(out).strip():
            out.append(t[at:])  # a quote that never ends is no reason to drop the whole post
        t = "\n".join(out)
    t = _QUOTED_OR_CODE.sub("\n", t)  # quoted lines first, as a quote may break off inside a code block; breaks inside a quoted line belong to it
    coded, codes = False, bool(_CODE_START.search(t))
    lines: list[str] = []
    for line in _BREAK.sub("\n", t).split("\n"):
        s = line.strip()
        if s.startswith((">", "|")) or s.endswith(":") and _WROTE.match(s):
            continue
        if s[:1] in _SIGNATURE_STARTS and s and _SIGNATURE.match(line) and any(x.strip() for x in lines):
            break
        if codes and (start := _CODE_START.search(line)):
            coded = True
            lines.append(line[: start.start()])
            line = line[start.end() :]
        if coded and _CODE_LINE.search(line) and not _LINK.search(line):
            continue
        lines.append(line)
    return "\n".join(lines)


def _link_words(m: re.Match) -> str:
    """A link as its host in one word and the words of its path."""
    host, _, path = re.sub(r"^https?://", "", m.group(), flags=re.I).partition("/")
    return f" {host.replace('.', 'x').replace('-', 'x').rstrip('x')} {regex.sub(r'[^\p{L}]+', ' ', path)} "


def plain(own: str) -> str:
    """What repeats are looked for in: markup gone, links with their addresses, tags as words, digits alike, no long runs."""
    links = _HREF.findall(own) if "://" in own or "www." in own else ()
    t = _TAG.sub(" ", own) if "[" in own or "<" in own else own
    t = _CAMEL.sub(" ", " ".join([t, *links]))
    t = t.lower().translate(_ALIKE)
    return _STRETCHED.sub(r"\1\1\1", _BLANK.sub(" ", t if t.isascii() else _DIGIT.sub("0", t))).strip()


def again(text: str, least: int = LEAST_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """Which characters lie in a run of ``least`` characters that occurs again, and in one that occurs ``OFTEN`` times.

    These are the characters that repeats, and phrases that occur so often, can cover at most (and, hashes apart, do cover).
    """
    n = len(text) - least + 1
    masks = np.zeros((2, len(text)), bool)
    if n < 2:
        return masks[0], masks[1]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = codes[:n].copy()
    for i in range(1, least):
        h *= np.uint64(0x100000001B3)
        h += codes[i : i + n]
    order = np.argsort(h)
    h = h[order]
    for mask, times in zip(masks, (2, OFTEN)):
        first = np.flatnonzero(h[times - 1 :] == h[: max(0, n - times + 1)])
        hit = np.zeros(n, bool)
        for k in range(times):
            hit[order[first + k]] = True
        for i in range(least):
            mask[i : i + n] |= hit
    return masks[0], masks[1]


def repeats(text: str, kept: np.ndarray, least: int = LEAST_REPEAT) -> tuple[float, int]:
    """Share of ``text`` in maximal repeats of at least ``least`` characters, by the suffix automaton over its ``kept`` stretches.

    And the letters in all occurrences of the repeat that has most of them, among those that occur ``OFTEN`` times.
    """
    at = np.flatnonzero(kept)
    if not len(at):
        return 0.0, 0
    go: list[dict] = [{}]
    link, length, end, prefix = [-1], [0], [0], []
    new, new_link, new_length, new_end, new_prefix = go.append, link.append, length.append, end.append, prefix.append
    last, before = 0, int(at[0]) - 1
    for i in at.tolist():
        # a mark of its own parts a stretch from the next
        for c in (text[i],) if i == before + 1 else (-i, text[i]):
            cur = len(go)
            new({})
            size = length[last] + 1
            new_length(size)
            new_end(i)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p < 0:
                new_link(0)
            else:
                q = go[p][c]
                size = length[p] + 1
                if size == length[q]:
                    new_link(q)
                else:
                    clone = cur + 1
                    new_link(clone)
                    new(go[q].copy())
                    new_length(size)
                    new_link(link[q])
                    new_end(end[q])
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = clone
                        p = link[p]
                    link[q] = clone
            last = cur
        before = i
        new_prefix(last)
    sizes, ends = np.array(length), np.array(end)
    order = np.argsort(sizes, kind="stable")[1:].tolist()
    count = [0] * len(go)
    for s in prefix:
        count[s] = 1
    for s in reversed(order):
        count[link[s]] += count[s]
    # the longest repeat that ends at a position is the nearest repeated state on the suffix path of its prefix
    reach = [0] * len(go)
    for s in order:
        reach[s] = length[s] if count[s] > 1 else reach[link[s]]
    longest = np.array([reach[s] for s in prefix])
    long = longest >= least
    edges = np.bincount((at - longest + 1)[long], minlength=len(text) + 1) - np.bincount(at[long] + 1, minlength=len(text) + 1)
    cover = float((np.cumsum(edges)[:-1] > 0).mean())
    counts = np.array(count)
    often = np.flatnonzero((counts >= OFTEN) & (sizes >= least))
    letters = np.concatenate([[0], np.cumsum([ch.isalpha() for ch in text])])
    weight = counts[often] * (letters[ends[often] + 1] - letters[ends[often] + 1 - sizes[often]])
    return cover, int(weight.max(initial=0))


def outside(own: str) -> float:
    """Share of letters outside of anything set like a sentence; letters of long words count up to ten, so that addresses do not weigh most."""
    total = alone = 0
    for part in (_TAG.sub(" ", own), " \n ".join(_HREF.findall(own))):
        part = _GREEK.sub("?", _CAMEL.sub(" ", _LINK.sub(_link_words, part)).replace("_", " "))
        at = 0
        for m in [*_SEGMENT.finditer(part), None]:
            piece = part[at : m.start() if m else len(part)]
            at = m.end() if m else 0
            words = [w for w in (_ASCII_WORD if piece.isascii() else _WORD).findall(piece) if not w.isdecimal()]
            if not words:
                continue
            letters = sum(min(len(w), 10) for w in words)
            total += letters
            first = piece.lstrip(" \t\u00a1\u00bf\"'(")[:1]
            end = (m.group(1) or m.group(2) or " ")[0] if m else " "
            spelled = 2 * sum(len(w) == 1 for w in words) > len(words) and not _NO_SPACE.search(piece)  # letters set apart
            enough = 2 <= len(words) <= 40 or len(words[0]) >= 6 and bool(_NO_SPACE.search(words[0]))
            if not (end in _ENDS and first and not first.islower() and enough and not spelled):
                alone += letters
    return alone / total if total else 0.0


def measure(text: str | None) -> tuple[int, float, float | None, float | None]:
    """Own letters, share of text in repeats; where that may be enough, share of letters in one phrase and of letters outside sentences."""
    own = own_text(text) if text and not text.isspace() else ""
    t = plain(own)
    n = sum(map(str.isalpha, t))
    if n < LEAST_LETTERS:
        return n, 0.0, None, None
    twice, often = again(t)
    if (most := float(twice.mean())) < COVERED:
        return n, most, None, None
    alone = outside(own)
    phrase = sum(t[i].isalpha() for i in np.flatnonzero(often).tolist()) / n
    if not is_spam(n, most, phrase, alone):
        return n, most, phrase, alone  # no automaton could change the verdict, as it finds no more than these bounds
    cover, letters = repeats(t, twice)
    return n, cover, min(phrase, letters / n), alone  # occurrences of a phrase may overlap, what they cover does not


def is_spam(n: int, cover: float, phrase: float | None, alone: float | None) -> bool:
    if n < LEAST_LETTERS or cover < COVERED:
        return False
    return cover + (alone or 0.0) >= TOGETHER or cover >= PHRASE_COVERED and (phrase or 0.0) >= PHRASE


def scores(documents: DataFrame) -> DataFrame:
    """``doc_id, letters, cover, phrase, outside, spam`` of every document; ``phrase`` and ``outside`` are NULL where repeats cover too little to ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t) for t in b.column("text").to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array([is_spam(*r) for r in rows], pa.bool_())], ["doc_id", "letters", "cover", "phrase", "outside", "spam"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, letters int, cover double, phrase double, outside double, spam boolean")


def found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of every spam post."""
    return scores(documents).where("spam").select("doc_id").distinct()
