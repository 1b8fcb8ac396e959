"""Template residue, filler and error-page text in place of content (problem 6).

Three detectors, in JVM expressions behind one wider look by RE2, over whole titles and bodies of any length:

* **Message templates.** Titles and bodies are messages. Their variable parts (numbers, addresses and paths,
  hexadecimal ids, the site's name) are masked; a prefix tree of fixed depth (number of words, then the
  first three) sorts them into leaves; a leaf's template keeps the word that most of its messages have at
  a place, and a wildcard elsewhere. A message that agrees with its leaf's template in fewer than half of the
  places is a template of its own. Each template is classified once, by the notices, access checks
  and stand-in titles of ``CUES``, and the verdict goes back to its messages. Of the bodies, only leaves
  with a body that holds a cue can have such a template; the others are not mined.
* **Unresolved slots** inside ordinary records: the placeholder syntaxes of the usual template
  languages. What stands between back quotes is quoted code and does not count; link targets
  are taken out first.
* **Filler**: a line of at least five words, most of them of the well-known pseudo-Latin; a title of at least two,
  if all are.

A body is a notice if at least a third of its letters are in sentences or lines with a cue, and it names what it
is about (an address, an id, a number) or is little else; a title must be little else. A text that tells about such
things has other words around them, and is no case. Null, empty and blank fields are no cases. Repeated rows come
out repeatedly; extra columns are ignored. Patterns take linear time on texts of any length. Texts are read
once; what is shuffled is a row for each field, and the words of the messages. Leaves are counted by partial
aggregates of (leaf, place, word), so a leaf with a third of all titles is no hot task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from fernglass.session import written

# Phrases of notices, access checks and stand-in titles, by language.
CUES = {
    "en": r"(?:this |the |that |requested ){0,3}(?:page|file|url|document|address)?,? ?(?:was |could |be |is |can ){0,3}not (?:be )?found|error(?: has)?(?: occurred)?|an error(?: has)? occurred|"
    r"internal server error|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|did not respond in time|forbidden|unauthori[sz]ed|access (?:is )?denied|"
    r"you don'?t have permission to (?:access|view)|just a moment|please wait|one moment(?: please)?|(?:are|confirm that) you(?: are)?(?: not)? (?:a )?(?:robot|human)|not a robot|checking your browser(?: before accessing)?|"
    r"(?:please )?(?:enable|turn on|activate|allow) (?:javascript|scripts|cookies)|javascript (?:is )?(?:required|disabled)|needs scripts to run|attention required|security check|captcha|"
    r"something went wrong|try again later|sorry, we looked everywhere|seems to have moved|fatal error|uncaught exception|stack trace|traceback|too many requests|under construction|"
    r"untitled(?: document| post| page)?|new (?:post|page|document)|(?:auto )?draft|sample \S+ title|headline goes here|\(copy\)|no title|title goes here",
    "de": r"(?:die )?seite(?: wurde)?(?: leider)? nicht gefunden|leider nicht gefunden|fehler|interner serverfehler|zugriff (?:verweigert|verboten)|keine berechtigung|schiefgelaufen|bitte aktivieren sie|"
    r"einen moment(?: bitte)?|bitte warten|sind sie ein (?:roboter|mensch)|ohne titel|neuer beitrag|nicht verfügbar",
    "fr": r"page (?:non trouvée|introuvable)|est introuvable|erreur(?: interne)?(?: du serveur)?|une erreur est survenue|accès (?:refusé|interdit)|vous n'avez pas accès|veuillez activer|un instant|"
    r"êtes-vous un robot|sans titre|nouvel article|service indisponible",
    "es": r"página no encontrada|no hemos encontrado|no (?:se )?encontrad[oa]|error(?: interno)?(?: del servidor)?|acceso (?:denegado|prohibido)|no tiene permiso|activ[ea] javascript|un momento(?:,? por favor)?|"
    r"¿?(?:es|eres) (?:usted )?un robot|sin título|nueva entrada|algo ha salido mal|servicio no disponible",
    "pt": r"página não encontrada|não encontramos|não encontrad[oa]|erro(?: interno)?(?: do servidor)?|acesso (?:negado|proibido)|não tem permissão|ative o javascript|um momento|você é um robô|sem título|novo post|serviço indisponível",
    "nl": r"pagina niet gevonden|niet gevonden|bestaat niet(?: op)?|fout|interne serverfout|toegang geweigerd|u mag .{0,40} niet bekijken|zet javascript aan|een ogenblik(?: geduld)?|bent u een robot|zonder titel|nieuw bericht|er is iets misgegaan",
}
_CUE = r"(?iU)(?<![\p{L}\p{N}])(?:" + "|".join(CUES.values()) + r")(?![\p{L}\p{N}])"

# Placeholder syntaxes.
SLOTS = (
    r"\$\{[^{}\n]+\}",
    r"\{\{[^{}\n]+\}\}",
    r"\{%[^%\n]+%\}",
    r"<%[^%\n]+%>",
    r"#\{[^{}\n]+\}",
    r"\{[A-Za-z_][\w.]*\}|\{\d{1,2}\}",
    r"\[\[\s*[A-Za-z_][\w. ]*\]\](?!\()",
    r"(?<!\w)__[A-Z][A-Z_]*[A-Z]__(?!\w)",
    r"%%[A-Za-z][\w.]*%%",
    r"@@[A-Za-z][\w.]*@@",
    r"(?<!\w)%[A-Z]+_[A-Z_]*[A-Z]%(?!\w)",
    r"\[(?:INSERT|ENTER|ADD|YOUR)\s[^\[\]\n]+\]",
    r"\[(?:insert|enter|add|your)\s[^\[\]\n]+\]?\s?\[?here\]",
)
# Whole titles that are a variable's name or an empty value.
EMPTY_TITLES = r"^\s*(?:[A-Z]+_[A-Z_]*[A-Z]|(?:null|undefined|NaN|None|\[object Object\])(?:\s*[|\-–—:·]\s.*)?)\s*$"

# The pseudo-Latin of filler text.
FILLER_WORDS = (
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse "
    "cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum sed sit minim"
)

# No group is repeated without bound: that would take a stack as deep as the text is long.
_RESOURCE = r"(?:https?://|/|(?<![\w.-])[\w-]+\.[\w.-]*[\w-]/)\S*[\w/]|(?<![\w.-])[\w-][\w.-]*\.[a-z]{2,8}(?=[\s.,]|$)"
_HEX = r"(?<![\w])#?[0-9a-f]{8,}(?![\w])"


def _trie(words: list[str]) -> str:
    """A pattern that matches exactly these words, by one walk through their common prefixes."""
    by: dict[str, list[str]] = {}
    for w in words:
        if w:
            by.setdefault(w[0], []).append(w[1:])
    alts = [c + _trie(rest) for c, rest in sorted(by.items())]
    if not alts:
        return ""
    return ("(?:" + "|".join(alts) + ")" if len(alts) > 1 or "" in words else alts[0]) + ("?" if "" in words else "")


def has_cue(text: Column) -> Column:
    return text.rlike(_CUE)


def _with_site(text: Column, site: Column | None) -> Column:
    return text if site is None else F.when(F.coalesce(site, F.lit("")) != "", F.replace(text, site, F.lit("<SITE>"))).otherwise(text)


def masked(text: Column, site: Column | None = None) -> Column:
    """The message with its variable parts as <SITE>, <RES>, <HEX> and <NUM>, and <NL> between its lines."""
    t = F.regexp_replace(F.trim(_with_site(text, site)), r"\n\s*", " <NL> ")
    t = F.regexp_replace(t, _RESOURCE, "<RES>")
    t = F.regexp_replace(t, _HEX, "<HEX>")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\d+", "<NUM>"), r"(?U)\s+", " "))


def rough_leaf(text: Column, site: Column | None = None, depth: int = 3) -> Column:
    """Equal for messages of one leaf: the number of words and the masked first ones, without masking the whole text."""
    t = F.trim(_with_site(text, site))
    first = masked(F.substring_index(t, " ", depth))
    return F.xxhash64(F.size(F.split(t, " ")), F.substring_index(first, " ", depth))


def mine_templates(messages: DataFrame, depth: int = 3, constant: float = 0.6, agree: float = 0.5) -> DataFrame:
    """(key, template): the template of every distinct masked text ``key``; ``messages`` has a column ``key``."""
    distinct = messages.groupBy("key").agg(F.count("*").alias("n")).withColumn("words", F.split("key", " "))
    leaf = F.concat_ws(" ", F.size("words").cast("string"), F.slice("words", 1, depth))
    distinct = distinct.withColumn("leaf", leaf)
    places = distinct.select("leaf", "n", F.posexplode("words").alias("place", "word")).groupBy("leaf", "place", "word").agg(F.sum("n").alias("n"))
    most = places.groupBy("leaf", "place").agg(F.max_by("word", F.struct("n", "word")).alias("word"), F.max("n").alias("top"), F.sum("n").alias("all"))
    kept = F.when(F.col("top") >= constant * F.col("all"), F.col("word")).otherwise("<*>")
    trees = most.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("place", kept.alias("word")))).alias("tree"))  # the words of one message
    trees = trees.select("leaf", F.transform("tree", lambda x: x["word"]).alias("tree"))
    same = F.size(F.filter(F.zip_with("words", "tree", lambda a, b: a == b), lambda x: x))
    return distinct.join(trees, "leaf").select("key", F.when(same >= agree * F.size("words"), F.concat_ws(" ", "tree")).otherwise(F.col("key")).alias("template"))


def classify(template: Column, field: Column) -> Column:
    """Whether a template is a notice or stand-in. A title must be little else; in a body a third of the letters must be
    in sentences with a cue, and it must name what it is about (an address, an id, a number) or be little else."""

    def letters(t: Column) -> Column:
        return F.length(F.regexp_replace(t, r"[^\p{L}]", ""))

    bare = F.regexp_replace(template, r"<(?:SITE|RES|HEX|NUM|NL|\*)>", "")
    rest = letters(F.regexp_replace(bare, _CUE, ""))
    cued = F.filter(F.split(template, r"(?<=[.!?…])\s+| <NL> "), lambda x: F.regexp_replace(x, r"<(?:SITE|RES|HEX|NUM|\*)>", "").rlike(_CUE))
    share = letters(F.regexp_replace(F.array_join(cued, " "), r"<(?:SITE|RES|HEX|NUM|NL|\*)>", ""))
    hit = bare.rlike(_CUE)
    in_body = (share >= letters(bare) / 3) & (template.rlike("<(?:RES|HEX|NUM)>") | (rest <= 0.5 * letters(bare)))
    return F.when(field == "title", hit & (rest <= 0.25 * letters(bare))).otherwise(hit & in_body)


#: Every slot holds one of these; most texts hold none, and are spared the patterns.
_SIGNS = ("{", "<%", "[[", "__", "%%", "@@", "_", "[INSERT", "[ENTER", "[ADD", "[YOUR", "[insert", "[enter", "[add", "[your")


def has_slot(text: Column) -> Column:
    return F.when(_any_of(text, _SIGNS), _has_slot(text)).otherwise(False)


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def _has_slot(text: Column) -> Column:
    prose = F.regexp_replace(F.regexp_replace(text, r"`[^`\n]*`", " "), r"\]\(https?://[^()\s]*\)", "")
    return prose.rlike("|".join(SLOTS)) | text.rlike(r"\[\[[A-Z ]{3,}\]\]\(http")


_FILLER = r"(?<!\w)" + _trie(sorted(set(FILLER_WORDS.split()))) + r"(?!\w)"


def has_filler(text: Column, whole: Column | None = None) -> Column:
    """Whether a line is filler; where ``whole`` holds, two words are enough if there are no others."""

    def filler(line: Column) -> Column:
        n, known = F.regexp_count(line, F.lit(r"(?U)\w+")), F.regexp_count(F.lower(line), F.lit(_FILLER))
        out = (n >= 5) & (known >= 0.6 * n)
        return out if whole is None else out | (whole & (n >= 2) & (known == n))

    return F.exists(F.split(text, "\n"), filler)


# What a text holds if it has a cue, a filler word or a slot: wider than the patterns above, for RE2, which reads a text by one
# automaton. No letter or digit of ASCII stands beside a cue or word; the only letters that a pattern's letter equals by case and
# RE2 does not fold are those for "i". (RE2's dot and \S are wider than Java's.)
def _loose(pattern: str) -> str:
    return r"(?i)(?:\A|[^0-9A-Za-z])(?:" + pattern.replace("i", "[i\u0131\u0130]") + r")(?:[^0-9A-Za-z]|\z)"


_CUED, _FILLABLE, _SLOTTED = _loose("|".join(CUES.values())), _loose("|".join(FILLER_WORDS.split())), "|".join(map(re.escape, _SIGNS))


def _sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, site, field, text, leaf), with (cued, fillable), and without the text of bodies that hold nothing suspect."""
    for b in batches:
        doc_id, site, field, text, leaf = b.columns
        cued, fillable, slotted = (pc.match_substring_regex(text, p) for p in (_CUED, _FILLABLE, _SLOTTED))
        needed = pc.or_(pc.or_(pc.equal(field, "title"), slotted), pc.or_(cued, fillable))
        yield pa.RecordBatch.from_arrays([doc_id, site, field, pc.if_else(needed, text, pa.scalar(None, text.type)), leaf, cued, fillable], [*b.schema.names, "cued", "fillable"])


def residue(docs: DataFrame, doc_id: str, title: str, body: str, site: str | None = None) -> DataFrame:
    """(doc_id, field, slot, filler, notice, template): every title and body that is or holds residue."""
    where = F.col(site) if site else F.lit(None).cast("string")
    src = docs.select(F.col(doc_id).alias("doc_id"), where.alias("site"), F.col(title).alias("t"), F.col(body).alias("b"))
    fields = src.select("doc_id", "site", F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("t").alias("text")), F.struct(F.lit("body").alias("field"), F.col("b").alias("text")))).alias("f"))
    fields = fields.select("doc_id", "site", "f.field", "f.text").where(F.trim("text") != "")
    is_title = F.col("field") == "title"
    fields = fields.withColumn("leaf", F.when(~is_title, rough_leaf(F.col("text"), F.col("site"))))
    fields = fields.mapInArrow(_sieve, StructType([*fields.schema, StructField("cued", BooleanType()), StructField("fillable", BooleanType())]))
    cue = is_title | F.when(F.col("cued"), has_cue(F.col("text"))).otherwise(False)
    marked = fields.select(
        "doc_id",
        "field",
        (has_slot(F.col("text")) | (is_title & F.col("text").rlike(EMPTY_TITLES))).alias("slot"),
        F.when(F.col("fillable"), has_filler(F.col("text"), is_title)).otherwise(False).alias("filler"),
        "leaf",
        F.when(cue, masked(F.col("text"), F.col("site"))).alias("key"),
    )
    marked = written(marked)  # the texts are read once
    # bodies without a cue in the leaf of one that has it
    bodies = marked.where("field = 'body'")
    leaves = bodies.where("key is not null").select("leaf").distinct()
    mates = written(bodies.where("key is null").join(leaves, "leaf", "left_semi").select("doc_id").distinct())
    theirs = written(src.join(mates, "doc_id", "left_semi").select("doc_id", F.lit("body").alias("field"), masked(F.col("b"), F.col("site")).alias("theirs")).distinct())
    messages = marked.where("key is not null").select("key").unionByName(theirs.select(F.col("theirs").alias("key")))
    notices = mine_templates(messages)
    # a template's verdict depends on the field as well; both are worked out once a template
    verdicts = notices.groupBy("template").agg(F.count("*").alias("n")).select("template", classify(F.col("template"), F.lit("title")).alias("as_title"), classify(F.col("template"), F.lit("body")).alias("as_body")).where("as_title or as_body")
    verdicts = notices.join(verdicts, "template").select("key", "template", "as_title", "as_body")
    marked = marked.join(theirs, ["doc_id", "field"], "left").withColumn("key", F.coalesce("key", "theirs"))
    out = marked.join(verdicts, "key", "left").withColumn("notice", F.coalesce(F.when(is_title, F.col("as_title")).otherwise(F.col("as_body")), F.lit(False)))
    return out.where("slot or filler or notice").select("doc_id", "field", "slot", "filler", "notice", "template")
