"""Main text of pages and article bodies, without what the site put around it (problem 5).

The leaf blocks of an HTML page are the runs of text between the borders of its block elements, each with its tag,
ancestors and links; those of a Markdown body are its lines with their marks. A linear-chain
conditional random field labels the blocks of a document as main text or boilerplate, decoded by
Viterbi. A line of a page is boilerplate if it shows text and all its blocks are boilerplate; a block that
goes over several lines gives them all its label.

The field is trained here, on a sample of ``TRAIN_DOCS`` documents of each kind by hash of the id, as far
as they fit ``TRAIN_CHARS`` characters in that order (the two bounds). No page comes with labels: the
blocks are labelled by labelling functions over what marks boilerplate beyond doubt: semantic
containers (nav, header, footer, aside), blocks that are all link, blocks beside the element that
holds the page's first heading, and blocks of at most two sentences that name the site, a mail address or a
copyright, or that end without a full stop and are no heading, list or quotation. Some features of the field see the
same marks (ancestors, links, ends), others do not (words, shapes, places, neighbours by the chain); the
latter carry the labels over to documents without the marks.

Defined cases: null and empty bodies have no lines. Bytes are decoded as UTF-8, else by the reply's
or the page's character set, else Windows-1252; line numbers count "\n". Text outside the body
element (where there is one), comments, scripts and styles show no text. Text of a page outside all block elements,
or in ``pre``, ends at "\n" too. Documents and lines of any length get the same features, in time linear in their length;
very long documents are trained on in pieces of ``PIECE`` blocks and decoded whole. Repeated rows come out repeatedly;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernglass.llm.crf import Crf, train
from fernglass.llm.words import Words, pieces

DIM = 1 << 16
TRAIN_DOCS = 1500
TRAIN_CHARS = 30_000_000
#: Blocks of one training sequence.
PIECE = 300

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|\n|[^<\n]+|<", re.S | re.I)
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}
_INLINE = {"a", "b", "i", "em", "strong", "span", "small", "u", "sub", "sup", "code", "abbr", "time", "mark", "q", "cite", "font", "br", "img"}
_UNBROKEN = {"html", "body", "pre", "textarea"}
_APART = {"nav", "header", "footer", "aside", "form"}
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w-]+)", re.I)
_SITE = re.compile(r"<meta\s[^>]*property=[\"']og:site_name[\"'][^>]*content=[\"']([^\"']*)", re.I)
_STOPS, _CLOSERS = tuple(".!?…"), "\"'”»«)]*_"
_SENTENCE = re.compile(r"[.!?…](?=\s|$)")
_LINK = re.compile(r"\[([^\[\]\n]*)\]\([^()\s]*\)")
_FIGURES = re.compile(r"^[-*•]?\s*[^:]{1,60}:\s*\d")
# What stands between the parts of a row, besides wide gaps.
_BETWEEN = re.compile(r" [|·/>›»•] ")
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def decode_page(body: bytes, charset: str | None) -> str:
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        m = _CHARSET.search(body[:2048])
        for c in (charset, m and m[1].decode("ascii", "ignore")):
            if c and c.lower().replace("_", "-") not in ("utf-8", "utf8", "iso-8859-1", "latin-1", "latin1"):
                try:
                    return body.decode(c)
                except (LookupError, UnicodeDecodeError):
                    pass
        return body.decode("cp1252", "replace")


def _stops(text: str) -> bool:
    """Whether a text ends with the end of a sentence."""
    return text.rstrip(_CLOSERS).endswith(_STOPS)


class Block:
    """A leaf block: text, and the lines that show it."""

    __slots__ = ("above", "inside", "lines", "linked", "path", "tag", "text")

    def __init__(self, line_no: int, tag: str, above: frozenset, path: tuple) -> None:
        self.lines, self.tag, self.above, self.path = [line_no], tag, above, path
        self.text, self.linked, self.inside = "", 0, False

    @property
    def line_no(self) -> int:
        return self.lines[0]


def page_blocks(page: str) -> tuple[list[Block], str]:
    """The blocks of an HTML page, and the site's name as the page gives it."""
    site = _SITE.search(page)
    blocks: list[Block] = []
    stack: list[tuple[str, int]] = []
    has_body = re.search(r"<body\b", page, re.I) is not None
    open_body, line, made, links = not has_body, 0, 0, 0
    now: Block | None = None
    plain = False  # the block's lines stand for themselves
    heading: tuple | None = None
    for m in _PIECE.finditer(page):
        t = m[0]
        if t == "\n":
            line += 1
            if now is not None:
                now.text += " "
                if plain:
                    now = None
        elif m[3]:
            tag = m[3].lower()
            if tag not in _INLINE:
                now = None  # the border of a block element
            if tag == "body":
                open_body = has_body and not m[2]
            elif m[2]:
                if any(x == tag for x, _ in stack):
                    while stack:
                        x, _ = stack.pop()
                        links -= x == "a"
                        if x == tag:
                            break
            elif tag not in _VOID and not m[4].endswith("/"):
                if open_body or tag in ("html",):
                    made += 1
                    stack.append((tag, made))
                    links += tag == "a"
                    if tag == "h1" and heading is None:
                        heading = tuple(k for _, k in stack[:-1])
            line += t.count("\n")
        elif t[0] == "<":
            line += t.count("\n")
        elif open_body and t.strip():
            if now is None:
                block = [x for x in stack if x[0] not in _INLINE]
                plain = not block or block[-1][0] in _UNBROKEN
                leaf = next((x[0] for x in reversed(stack) if x[0] in ("small", "span")), None) or (block[-1][0] if block else "")
                now = Block(line, leaf, frozenset(x for x, _ in stack), tuple(k for _, k in stack))
                blocks.append(now)
            elif now.lines[-1] != line:
                now.lines.append(line)
            text = html.unescape(t)
            now.text += text
            if links:
                now.linked += len(text.strip())
    for b in blocks:
        b.inside = heading is not None and b.path[: len(heading)] == heading
    return [b for b in blocks if b.text.strip()], html.unescape(site[1]) if site else ""


def body_blocks(body: str) -> list[Block]:
    """The blocks of a Markdown body."""
    out = []
    for i, ln in enumerate(body.split("\n")):
        if ln.strip():
            b = Block(i, "", frozenset(), ())
            b.text, b.inside = ln, True
            out.append(b)
    return out


_codes: dict[str, int] = {}


def _code(f: str) -> int:
    c = _codes.get(f)
    if c is None:
        if len(_codes) > 400_000:
            _codes.clear()
        c = _codes[f] = zlib.crc32(f.encode("utf-8", "replace")) & (DIM - 1)
    return c


# Codes of what many blocks have in common, remembered by the worker.


@lru_cache(4096)
def _codes_of(*features: str) -> tuple[int, ...]:
    return tuple(map(_code, features))


@lru_cache(20_000)
def _place(kind: str, start: int, end: int, apart: str, words) -> tuple[int, ...]:
    return _codes_of(kind, f"{kind} from start {start}", f"{kind} from end {end}", f"words {words}", *([apart] if apart else []))


@lru_cache(20_000)
def _shape(end: str, many: int, mark: str) -> tuple[int, ...]:
    return _codes_of(f"end {end}", f"sentences {many}", f"mark {mark}", f"end {end} sentences {many}", f"mark {mark} end {end}")


@lru_cache(20_000)
def _markup(tag: str, inside: bool, end: str, above: frozenset, share: str) -> tuple[int, ...]:
    return _codes_of("tag " + tag, "with heading" if inside else "beside heading", f"tag {tag} end {end} {inside}", *["above " + a for a in sorted(above)], f"link {share}", f"end {end} {inside}")


def _split(text: str) -> list[str]:
    return ["0" if w.isdigit() else w for w in _WORD.findall(text)]


_words, _word_codes = Words(_split), np.empty(0, np.int64)


def _word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case texts: how many distinct codes their words have, and these; whether they have words, and the codes of
    the first two and last words of those that have."""
    global _word_codes
    if _words.full():
        _words.clear()
        _word_codes = _word_codes[:0]
    lens, ids = _words.numbers(texts)
    names = _words.words
    new = [zlib.crc32(("w " + w).encode("utf-8", "replace")) & (DIM - 1) for w in names[len(_word_codes) :]]
    _word_codes = np.concatenate([_word_codes, np.array(new, np.int64)])
    own = np.repeat(np.arange(len(texts)) * DIM, lens) + _word_codes[ids]
    own.sort()
    own = own[np.diff(own, prepend=-1) > 0]
    some = np.flatnonzero(lens)
    ends = np.cumsum(lens)[some]
    begins = ends - lens[some]
    # of a text with one word, this is also its second place
    seconds = np.minimum(begins + 1, ends - 1)
    codes = [
        (_code(f"first {names[a]} {names[b]}" if n > 1 else "first " + names[a]), _code("last " + names[z]))
        for a, b, z, n in zip(ids[begins].tolist(), ids[seconds].tolist(), ids[ends - 1].tolist(), lens[some].tolist(), strict=True)
    ]
    return np.bincount(own // DIM, minlength=len(texts)), own % DIM, lens > 0, np.array(codes, np.int64).reshape(-1, 2)


def _put(out: np.ndarray, at: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Puts the next ``sizes`` values at each place; gives the places after them."""
    out[np.arange(len(values)) + np.repeat(at - np.cumsum(sizes) + sizes, sizes)] = values
    return at + sizes


def flat_features(docs: list[tuple[list[Block], str]], is_page: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of every block of each document (blocks, site), flat as in ``crf``."""
    shapes: list[tuple[int, ...]] = []
    lows = []
    kind = "page" if is_page else "body"
    for blocks, name in docs:
        site = " ".join((name or "").lower().split())
        n, before = len(blocks), -2
        for i, b in enumerate(blocks):
            s = " ".join(b.text.split())
            words = s.count(" ") + 1
            f = _place(kind, min(i, 3), min(n - 1 - i, 6), "" if is_page else "joined" if b.line_no == before + 1 else "apart", min(words, 12) if words <= 30 else "many")
            before = b.line_no
            plain = _LINK.sub(r"\1", s) if "](" in s else s
            end = "stop" if _stops(plain) else plain[-1:] if not plain[-1:].isalnum() else "open"
            m = _SENTENCE.search(plain)
            many = 0 if m is None else 1 if _SENTENCE.search(plain, m.end()) is None else 2
            f += _shape(end, many, plain[:1] if not plain[:1].isalnum() else "letter")
            low = plain.lower()
            lows.append(low.replace(site, " ownsite ") if site and site in low else low)
            if _FIGURES.match(plain):
                f += _codes_of("figures")
            if plain.isupper():
                f += _codes_of("capitals")
            if "@" in plain:
                f += _codes_of("mail")
            text = b.text.strip()
            if "  " in text or _BETWEEN.search(text):
                f += _codes_of("row")
            if is_page:
                share = b.linked / max(len(s), 1)
                f += _markup(b.tag, b.inside, end, b.above, "all" if share > 0.85 else "some" if share else "none")
            shapes.append(f)
    if not shapes:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.array([len(bs) for bs, _ in docs], np.int64)
    sizes = np.fromiter(map(len, shapes), np.int64, len(shapes))
    got = [_word_features(part) for part in pieces(lows)]
    n_words, words, some, ends = (np.concatenate(x) for x in zip(*got, strict=True))
    counts = sizes + n_words
    counts[some] += 2
    starts = np.cumsum(counts) - counts
    feats = np.empty(int(counts.sum()), np.int64)
    at = _put(feats, starts, sizes, np.fromiter(chain.from_iterable(shapes), np.int64, int(sizes.sum())))
    at = _put(feats, at, n_words, words)[some]
    feats[at], feats[at + 1] = ends[:, 0], ends[:, 1]
    return feats, starts, np.array([len(bs) for bs, _ in docs], np.int64)


def features(blocks: list[Block], site: str, is_page: bool) -> list[list[int]]:
    """Hashed features of every block of one document."""
    feats, starts, _ = flat_features([(blocks, site)], is_page)
    return [f.tolist() for f in np.split(feats, starts[1:])] if len(starts) else []


def weak_label(b: Block, site: str, is_page: bool) -> int:
    """1 (boilerplate) or 0 by the labelling functions."""
    s = " ".join(b.text.split())
    plain = _LINK.sub(r"\1", s) if "](" in s else s
    if is_page and (not b.inside or b.above & _APART or b.linked > 0.85 * len(s)):
        return 1
    if is_page and b.tag in ("h1", "h2", "h3", "h4"):
        return int(bool(site) and site.lower() in s.lower())
    if ((site and site.lower() in plain.lower()) or "©" in plain or re.search(r"\S@\S+\.\S", plain)) and sum(1 for _ in islice(_SENTENCE.finditer(plain), 3)) < 3:
        return 1
    if plain.startswith("#") or _FIGURES.match(plain) and plain[:1] in "-*" or is_page and b.tag == "li" and _FIGURES.match(plain):
        return 0
    return int(not _stops(plain))


def _documents(batch: pa.RecordBatch, is_page: bool):
    """(row, blocks, site) of every document of the batch: id, text or bytes, site or character set."""
    for i, (text, more) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
        if text:
            if is_page:
                yield i, *page_blocks(decode_page(text, more))
            else:
                yield i, body_blocks(text), more or ""


def _flat(docs: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes = [f for d in docs for f in d]
    feats = np.fromiter((x for f in nodes for x in f), np.int64)
    starts = np.concatenate([[0], np.cumsum([len(f) for f in nodes])[:-1]]).astype(np.int64) if nodes else np.empty(0, np.int64)
    return feats, starts, np.array([len(d) for d in docs], np.int64)


def fit(bodies: DataFrame | None, pages: DataFrame | None, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Crf:
    """Train on a bounded sample. ``bodies``: id, text, site; ``pages``: id, bytes, character set (by position)."""
    parts, lens, labels = [], [], []
    for df, is_page in ((bodies, False), (pages, True)):
        if df is None:
            continue
        key, text, more = df.columns[:3]
        sizes = df.where(F.length(text) > 0).select(key, F.length(text).alias("size")).orderBy(F.xxhash64(key), key).limit(train_docs).collect()  # at most train_docs numbers
        ids, left = [], train_chars
        for i, size in sizes:
            if size <= left:
                ids.append(i)
                left -= size
        docs = []
        sample = df.where(F.col(key).isin(ids)).orderBy(F.xxhash64(key), key)
        for batch in sample.select(key, text, more).toArrow().to_batches():
            docs += [(blocks, site) for _, blocks, site in _documents(batch, is_page) if blocks]
        feats, starts, sizes = flat_features(docs, is_page)
        parts.append((feats, starts))
        for n in sizes.tolist():
            lens += [PIECE] * (n // PIECE) + [n % PIECE] * (n % PIECE > 0)
        labels += [weak_label(b, site, is_page) for blocks, site in docs for b in blocks]
    offset = np.cumsum([0, *(len(f) for f, _ in parts)])
    feats = np.concatenate([f for f, _ in parts]) if parts else np.empty(0, np.int64)
    starts = np.concatenate([s + o for (_, s), o in zip(parts, offset, strict=False)]) if parts else np.empty(0, np.int64)
    return train(feats, starts, np.array(lens, np.int64), np.array(labels, np.int64), DIM)


def boilerplate_lines(df: DataFrame, crf: Crf, is_page: bool) -> DataFrame:
    """(record_id, line_no) of every line of boilerplate. Columns of ``df`` by position, as for ``fit``."""
    key, text, more = df.columns[:3]
    model = df.sparkSession.sparkContext.broadcast(crf)  # DIM weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                docs = [(i, bs, site) for i, bs, site in _documents(part, is_page) if bs]
                if not docs:
                    continue
                got = iter(model.value.decode(*flat_features([(bs, site) for _, bs, site in docs], is_page)).tolist())
                which, no = [], []
                for i, bs, _ in docs:
                    gone, kept = set(), set()
                    for b in bs:
                        (gone if next(got) else kept).update(b.lines)
                    gone = sorted(gone - kept)
                    which += [i] * len(gone)
                    no += gone
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which, pa.int64())), pa.array(no, pa.int64())], ["record_id", "line_no"])

    return df.select(F.col(key).cast("long").alias("record_id"), text, more).mapInArrow(run, "record_id long, line_no long")


def own_lines(crf: Crf, texts: list[str], sites: list[str | None]) -> list[list[str]]:
    """The lines of each Markdown body that are main text."""
    blocks = [body_blocks(t) for t in texts]
    got = iter(crf.decode(*flat_features([(bs, s or "") for bs, s in zip(blocks, sites, strict=True) if bs], False)).tolist())
    return [[b.text for b in bs if not next(got)] for bs in blocks]


def without_lines(df: DataFrame, key: str, text: str, drop: DataFrame) -> DataFrame:
    """(record_id, n_removed, body): the texts without the lines in ``drop`` (record_id, line_no)."""
    gone = drop.groupBy("record_id").agg(F.collect_set(F.col("line_no").cast("int")).alias("drop"))
    src = df.select(F.col(key).cast("long").alias("record_id"), F.col(text).alias("body"))
    kept = F.filter(F.split("body", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains(F.col("drop"), i), F.lit(False)))
    return src.join(gone, "record_id", "left").select("record_id", F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"), F.concat_ws("\n", kept).alias("body"))
