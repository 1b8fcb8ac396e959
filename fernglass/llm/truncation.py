"""Values that stop before their text does (problem 1).

Each value is brought to plain text (tags out, entities decoded, white space as single spaces), the
signs that more follows are taken off its end, and its ending is read: inside a tag or entity;
closed by a full stop; a credit, hashtag, address or quotation; a rhetorical "..."; or open. An ending that looks like half an
entity or tag but stands as a word elsewhere ("R&D", "<") is none.

**Self-join by prefix.** All distinct texts are range-partitioned and sorted. If any text has another
one as a strict prefix, then so has the next one in the order, so one look at the next text finds
what continues a value, in copies of the item, in other feeds and in the other field. What follows
there tells whether the value stops inside a word or sentence. The texts at the borders of the
partitions (two for each partition) are compared on the driver. A prefix that is shared by a third of
all texts is just a long stretch of the order, spread over many partitions.

**Word and sentence ends.** Values without a longer copy are judged by the corpus: an open value
whose last word stands nowhere else as a word (in fewer than ``KNOWN`` places) stops inside a word.
Of every sentence of every value the last four words (names and numbers masked, with the sentence's
start) are counted; an open value whose last words no sentence ends with stops inside a sentence.
One whose last words could end a sentence is cut only if its length is the limit of its source: of
the certain cases of one source and field, where at least ``LIMIT_CASES`` have lengths within
``LIMIT_WIDTH``.

Nulls, empty and blank values are no cases. Repeated rows come out repeatedly, extra columns are
ignored, ties do not matter. Very long values: only their text is sorted, nothing is gathered.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fernglass.session import written

LIMIT_CASES, LIMIT_WIDTH = 5, 10
END_SHARE = 0.01  # of the places with these last words that must be sentence ends
KNOWN = 3

_TAG = re.compile(r"<[^<>]*>")
_OPEN_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*$|<[/!]?$")
_OPEN_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]*|[A-Za-z]{0,7})$")
_ENTITY_NAMES = sorted(k for k in html.entities.html5 if k.endswith(";"))
# Signs that more follows, by themselves at the end of a value.
_MORE = re.compile(
    r"(?:\s*(?:\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|…|\.\.\.|&hellip;?|»|[\[(](?:more|mehr|suite|más|mais|meer)[\])]"
    r"|(?:read more|continue reading|weiterlesen|lire la suite|leer más|seguir leyendo|leia mais|lees (?:meer|verder))\s*[»→>]*))+\s*$",
    re.I,
)
# Last sentences that end in a rhetorical ellipsis, by language.
_RHETORIC = re.compile(
    r"^(?:more from .* soon|and .* still waits?|so much for .*|to be continued|who knows|we shall see|mehr aus .* folgt|und .* wartet|fortsetzung folgt|"
    r"à suivre.*|et .* attend|seguirá.*|continuará.*|y .* espera|continua.*|e .* espera|meer uit .* volgt|en .* wacht|wordt vervolgd)$",
    re.I,
)
_CLOSED = re.compile(r"[.!?][\"'”»’)\]]*$")
_CREDIT = re.compile(r"(?:^|[.!?…\"”»]\s*)(?:\([^()]{2,80}\)|[—–]\s[^.!?]{2,80}|[\"“«][^\"”»]{1,80}[\"”»])$|https?://[^\s<>]+$|(?:^|\s)#\w+$|\S@\S+\.\w+$")
_SENTENCE = re.compile(r"(?:(?<!\d)\.|\.(?=[\"'”»’)\]])|[!?…])[.!?…]*[\"'”»’)\]]*\s+")  # not after an ordinal
_ORDINAL = re.compile(r"\s\d{1,4}\.$")


def plain(value: str) -> tuple[str, bool]:
    """The text of a value, and whether it stops inside a tag or an entity."""
    broken = False
    if "<" in value:
        bare = _TAG.sub(" ", value)
        if (m := _OPEN_TAG.search(bare)) is not None:
            bare, broken = bare[: m.start()], True
        value = bare
    if "&" in value:
        value = value.rstrip()
        if (m := _OPEN_ENTITY.search(value)) is not None and (m[1][:1] == "#" or (m[1] or value[-2:-1].strip()) and any(e.startswith(m[1]) for e in _ENTITY_NAMES)):
            value, broken = value[: m.start()], True
        value = html.unescape(value)
    return " ".join(value.split()), broken


def masked(word: str) -> str:
    w = word.strip("\"'“”«»()[]")
    if any(c.isdigit() for c in w):
        return "#"
    return "N" if w[:1].isupper() else w.rstrip(".,;:!?").lower()


def context(sentence: str) -> str:
    """The last four words of a sentence, masked; ^ is its start. A sentence does not end with a comma."""
    words = sentence.split()
    if len(words) == 1:
        return "^"  # which no sentence ends with
    last = ["^", *map(masked, words[-4:])] if len(words) < 4 else [*map(masked, words[-4:])]
    return " ".join(last[-4:]) + ("," if sentence.rstrip()[-1:] in ",;:-–—(" else "")


def last_word(text: str) -> str:
    return text.split()[-1].strip("\"'“”«»()[].,;:!?…") if text else ""


def reading(value: str) -> tuple[str, str, bool]:
    """(text without its sign, ending, marked); ending is broken, rhetoric, closed, credit or open."""
    text, broken = plain(value)
    m = _MORE.search(text)
    marked = m is not None
    if marked:
        text = text[: m.start()].rstrip()
    if broken:
        return text, "broken", marked
    if marked:
        last = _SENTENCE.split(text)[-1]
        if _RHETORIC.match(last):
            return text, "rhetoric", marked
    if _CREDIT.search(text):
        return text, "credit", marked
    if _CLOSED.search(text) and not (_ORDINAL.search(text) and re.search(r"\b(?:zum|am|vom|der|dem)\s\d{1,4}\.$", text)):
        return text, "closed", marked
    return text, "open", marked


def _read(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                ids, source, titles = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
                out: list[list] = [[] for _ in range(10)]
                seen: set[int] = set()
                for k, field in enumerate(fields):
                    for i, s, title, v in zip(ids, source, titles, b.column(k + 3).to_pylist(), strict=True):
                        if not v or not v.strip():
                            continue
                        text, ending, marked = reading(v)
                        h = xxhash.xxh3_64_intdigest(text) - 2**63
                        new = h not in seen
                        seen.add(h)
                        title = ending == "open" and title is not None and text == " ".join(title.split())
                        row = (i, s, field, h, text if new else None, "title" if title else ending, marked, len(text), context(_SENTENCE.split(text)[-1]) if ending == "open" else None, last_word(text) if ending == "open" else last_word(v) if ending == "broken" else None)
                        for col, x in zip(out, row, strict=True):
                            col.append(x)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["record_id", "source", "field", "h", "text", "ending", "marked", "chars", "ctx", "word"])

    return run


READ = "record_id long, source long, field string, h long, text string, ending string, marked boolean, chars int, ctx string, word string"


def _follows(text: str, longer: str) -> str:
    """Whether a text that goes on as ``longer`` stops inside a word or sentence: inside, open (it may) or no."""
    rest = longer[len(text) :]
    if text[-1:].isalnum() and rest[0].isalnum():
        return "inside"
    if rest[0] in ".!?…":
        return "no"
    word = rest.strip()[:1]
    if rest[0] == " " and (word.isupper() or word in "\"“«(—–#" or rest.strip().startswith("http")):
        return "open"
    return "inside"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts of the texts of one sorted partition; its first and last text go out as they are, for the borders."""
    part = TaskContext.get().partitionId()
    held: str | None = None
    first: str | None = None

    def rows(r: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*r, strict=True) if r else [()] * 5, kinds, strict=True)], ["h", "follows", "part", "edge", "text"])

    for b in batches:
        out = []
        for t in b.column(0).to_pylist():
            if held is None:
                first = t
            elif t != held and held and t.startswith(held):
                out.append((xxhash.xxh3_64_intdigest(held) - 2**63, _follows(held, t), None, None, None))
            held = t
        yield rows(out)
    if held is not None:
        yield rows([(None, None, part, "first", first), (None, None, part, "last", held)])


def continuations(read: DataFrame) -> DataFrame:
    """(h, follows) of every text that is a strict prefix of another one."""
    spark = read.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = read.where("text is not null").select("text")
    scanned = written(texts.repartitionByRange(n, "text").sortWithinPartitions("text").mapInArrow(_scan, "h long, follows string, part int, edge string, text string"))
    edges = sorted((r.part, r.edge, r.text) for r in scanned.where("edge is not null").select("part", "edge", "text").collect())  # two texts a partition
    more = []
    for (_, kind, text), (_, kind2, nxt) in zip(edges, edges[1:], strict=False):
        if kind == "last" and kind2 == "first" and text and nxt != text and nxt.startswith(text):
            more.append((xxhash.xxh3_64_intdigest(text) - 2**63, _follows(text, nxt)))
    found = scanned.where("edge is null").select("h", "follows")
    if more:
        found = found.unionByName(spark.createDataFrame(more, "h long, follows string"))
    return found.distinct()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each four words stand at a sentence's end and anywhere (kind c), and each word anywhere but at the
    end of a text (kind w)."""
    ends: Counter = Counter()
    places: Counter = Counter()
    words: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys, ws = list(places), Counter()
        for w, n in words.items():
            ws[w.strip("\"'“”«»()[].,;:!?…")] += n
        cols = [["c"] * len(keys) + ["w"] * len(ws), keys + list(ws), [ends[k] for k in keys] + [0] * len(ws), [places[k] for k in keys] + list(ws.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["kind", "key", "ends", "places"])

    known: dict[str, str] = {}
    for b in batches:
        for text in b.column(0).to_pylist():
            words.update(text.split()[:-1])
            for s in _SENTENCE.split(text + " ")[:-1]:
                m = ["^"]
                for w in s.split():
                    x = known.get(w)
                    if x is None:
                        if len(known) > 200_000:
                            known.clear()
                        x = known[w] = masked(w)
                    m.append(x)
                if len(m) > 4:
                    del m[0]
                four = [" ".join(x) for x in zip(m, m[1:], m[2:], m[3:], strict=False)] if len(m) > 3 else [" ".join(m)]
                places.update(four)
                ends[four[-1]] += 1
        if len(places) + len(words) > 400_000:
            yield out()
            for c in (ends, places, words):
                c.clear()
    if places or words:
        yield out()


def truncated(df: DataFrame, record_id: str, source: str, title: str, fields: list[str]) -> DataFrame:
    """(record_id, field, source, reason): every value that stops before its text does."""
    src = df.select(F.col(record_id).cast("long"), F.col(source).cast("long"), F.col(title).cast("string"), *fields)
    read = written(src.mapInArrow(_read(fields), READ))
    rows = read.drop("text")
    follows = continuations(read)
    # the counts are only asked for the last words of open, unsigned values
    unsure = rows.where("ending = 'open' and not marked or ending = 'broken'")
    asked = unsure.select(F.explode(F.array(F.struct(F.lit("c").alias("kind"), F.col("ctx").alias("key")), F.struct(F.lit("w").alias("kind"), F.col("word").alias("key")))).alias("x")).select("x.*").where("key is not null").distinct()
    counts = read.where("text is not null").select("text").mapInArrow(_counted, "kind string, key string, ends long, places long").groupBy("kind", "key").agg(F.sum("ends").alias("ends"), F.sum("places").alias("places"))
    answers = written(asked.join(counts, ["kind", "key"]))
    ctx = answers.where("kind = 'c'").select(F.col("key").alias("ctx"), "ends", "places")
    known = answers.where("kind = 'w'").select(F.col("key").alias("word"), F.col("places").alias("seen"))
    judged = rows.where("ending in ('broken', 'open', 'title', 'credit')").join(follows, "h", "left").join(ctx, "ctx", "left").join(known, "word", "left")
    complete = (F.col("ends") >= F.greatest(F.lit(2), END_SHARE * F.col("places"))) & (F.col("seen") >= KNOWN)
    cut_inside = (F.col("follows") == "inside") & F.col("ending").isin("open", "title", "credit")
    reason = (
        F.when((F.col("ending") == "broken") & (F.coalesce(F.col("seen"), F.lit(0)) < KNOWN), "markup")
        .when((F.col("ending") == "open") & F.col("marked"), "sign")
        .when(cut_inside, "prefix")
        .when((F.col("ending") == "open") & ~F.coalesce(complete, F.lit(False)), F.when(F.col("follows") == "open", "prefix").when(F.coalesce(F.col("seen"), F.lit(0)) < KNOWN, "word").otherwise("sentence"))
    )
    judged = judged.withColumn("reason", reason)
    # the limits of sources, from the certain cases without a sign
    sure = judged.where("reason in ('prefix', 'sentence', 'word')").groupBy("source", "field").agg(F.count("*").alias("cases"), F.percentile_approx("chars", 0.25).alias("low"), F.percentile_approx("chars", 0.9).alias("high"))
    limits = sure.where((F.col("cases") >= LIMIT_CASES) & (F.col("high") - F.col("low") <= LIMIT_WIDTH))
    out = judged.join(limits, ["source", "field"], "left")
    at_limit = (F.col("ending") == "open") & F.col("chars").between(F.col("low") - 4, F.col("high") + 4)
    found = out.withColumn("reason", F.coalesce("reason", F.when(at_limit, "limit"))).where("reason is not null").select("record_id", "field", "source", "reason")
    # what looks complete and goes on inside a sentence in a longer copy ("3." of "3.5", "U.S. of")
    seems = rows.where("ending in ('closed', 'rhetoric')").select("record_id", "field", "source", "h").join(follows.where("follows = 'inside'").select("h"), "h")
    return found.unionByName(seems.select("record_id", "field", "source", F.lit("prefix").alias("reason")))


def rates(df: DataFrame, cases: DataFrame, source: str, fields: list[str]) -> DataFrame:
    """(source, field, n_values, n_truncated, share): how often each source cuts each field."""
    values = df.select(F.col(source).cast("long").alias("source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("x")).where(F.trim("x.v") != "")
    totals = values.groupBy("source", F.col("x.field").alias("field")).agg(F.count("*").alias("n_values"))
    cut = cases.groupBy("source", "field").agg(F.count("*").alias("n_truncated"))
    return totals.join(cut, ["source", "field"], "left").select("source", "field", "n_values", F.coalesce("n_truncated", F.lit(0)).alias("n_truncated"), (F.coalesce("n_truncated", F.lit(0)) / F.col("n_values")).alias("share"))
