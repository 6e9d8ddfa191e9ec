"""Structure of parsed documents: what each item is, which items are body text, and the outline they form.

Everything that looks at one item, or at its place among its neighbours, is a native expression: cleaning, recognising headings,
notes and noise, repeated stamps, headings printed out of place, annexes, contents pages, the start and the end of the body. Only what
depends on what was accepted before (paragraph numbers, titles of bare chapters) is folded in Python, from rows that carry their kind.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, unescape

# ---- fixed values: the patterns that recognise structure ---------------------------------------
ROMAN = r"[IVXL]+"
CHAPTER = rf"^(?i:chapter)\s*[-–]?\s*({ROMAN}|\d+)\b(?!\s+(?:of|to|in|and|under|as|shall|is|read|above|below)\b)\s*[-–:]?\s*(.*)$"
BARE_CHAPTER = rf"^(?i:chapter)\s*[-–]?\s*{ROMAN}$"
INLINE_CHAPTER = rf"(?<=[.;:])\s+(?=(?i:chapter)\s*[-–]?\s*(?:{ROMAN}|\d+)\b\s*[-–:])"
SECTION = r"^(?:[A-H]\.\s+\S.*|Part\s*[-–]?\s*(?:[IVX]+|[A-Z]|\d+)\b\s*[-–:]?\s*.*)$"
SUBSECTION = r"^([A-H])\.\d+(?:\.\d+)*\s+[A-Z]\S*"
ANNEX = rf"^(?:Annex(?:ure)?|Appendix)\s*[-–:]?\s*({ROMAN}|\d+|[A-Z])\b"
ANNEX_AT_END = rf"\b(?:Annex(?:ure)?|Appendix)\s*[-–:]?\s*({ROMAN}|\d+)\s*$"
ANNEX_REFERENCE = rf"(?i)\b(?:in|see|to|of|per|under|with|vide|at|and|or|the|refer|given|placed|annexed|enclosed|is|are)\s*(?-i:\b(?:Annex(?:ure)?|Appendix)\s*[-–:]?\s*(?:{ROMAN}|\d+)\s*)$"
PARA = r"^(?:Q\.?\s*)?(\d{1,3})([A-Z])?\.(?:\s+(?=\S)|(?=[A-Z][a-z])|$)"
PARA_NUMBER = r"^(?:Q\.?\s*)?\d{1,3}[A-Z]?\.\s*"
INLINE_PARA = r"(?<=[.;:a-z])\s+(\d{1,3})\.\s+(?=(?:\d{1,3}\s+)?[A-Z])"
REFERENCE_WORD = r"(?i)(?:para(?:graph)?|section|rule|clause|chapter|annex|item|no)\.?\s*$"
SUBCLAUSE = r"^(?:\(\s*(?:\d{1,2}|[ivxl]+|[a-z])\s*\)|(?:\d{1,2}|[ivxl]+|[a-z])\)|[ivxl]+\.|\d+\.\d+\.?)\s"
FOOTNOTE = r"(?is)^(\d{1,3})\s*((?:Inserted|Substituted|Amended|Deleted|Added|Omitted)\b.*(?:with effect from|w\.e\.f\.?|vide).*)$"
FOOTNOTE_MARK = r"(?:\[\s*{n}\s*|(?:^|(?<=\)\s)|(?<=\.\s)){n}\s+)(?=[A-Z(‘'\"\[])"
DELETED_MARK = r"^\d{1,3}\s*\[\*+\]$"
SIGNATURE = r"^\((?:[A-Z][A-Za-z.]*\s*){1,6}\)(?:\s|$)"
DISTRIBUTION = r"(?i)^(?:Copy (?:for information )?to\b|To,?$|Encl(?:osure)?s?\b)"
CONTENTS = r"(?i)^(?:Table of Contents|Contents|Index)$"
DOT_LEADER = r"\.{8,}\s*\d{1,3}\b|\.{5,}\s*\d*\s*$"
PREAMBLE = r"(?i)^(?:Introduction|Preamble|Background)\b"
NOISE = r"^(?:\d{1,3}|[*_\-–. ]+|(?:www\.|https?://)\S+)$"
STAMP = r"^[A-Za-z]+(?: [A-Za-z]+){0,2}$"
SENTENCE_END = r"[.:;!?)\]\"'’”]$"
DROPPED_LABELS = ("page_header", "page_footer", "document_index", "picture")
STAMP_CHARS, PICTURE_CHARS, BODY_CHARS = 25, 40, 200
CHAPTER_CHARS, ANNEX_CHARS, TITLE_CHARS, NOTE_CHARS, SIGNATURE_CHARS = 250, 150, 120, 400, 150
STAMP_PAGES, ALONE_SHARE, STRIP_SHARE = 3, 0.15, 0.5


def has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?U)" + pattern), F.lit(False))


def part(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match, '' if there is none."""
    return F.coalesce(F.regexp_extract(c, "(?U)" + pattern, group), F.lit(""))


def last_words(c: Column, n: int) -> Column:
    """The last ``n`` words of a longer text if they could be a stamp, else ''. Looks at the end of the text only."""
    return part(F.substring(c, -STAMP_CHARS - 1, STAMP_CHARS + 1), " (" + " ".join(["[A-Za-z]+"] * n) + ")$", 1)


# ---- layout -------------------------------------------------------------------------------------------

def repeated_stamps(items: DataFrame) -> DataFrame:
    """(doc, stamp, alone, either, dropped, stripped): short texts that stand alone on some page, the pages on which they do, the pages on
    which they stand alone or end an item, and what becomes of them: left out where alone, or also cut off the ends of other items.

    Null documents, texts and pages count as values of their own kind (a null page is no page). One shuffle by (doc, stamp).
    """
    t = F.trim("text")
    row = lambda c, kind: F.when(c != "", F.struct(c.alias("stamp"), F.lit(kind).alias("kind")))
    alone = F.when((F.length(t) <= STAMP_CHARS) & t.rlike(STAMP), t)
    seen = F.array(F.struct(F.lit("").alias("stamp"), F.lit(0).alias("kind")), row(alone, 1), *[row(last_words(F.rtrim("text"), n), 2) for n in (1, 2, 3)])
    per = items.select("doc", "page", F.explode(F.array_compact(seen)).alias("x")).groupBy("doc", F.col("x.stamp").alias("stamp"))
    out = per.agg(F.count_distinct(F.when(F.col("x.kind") == 1, F.col("page"))).alias("alone"), F.count_distinct("page").alias("either"), F.max((F.col("x.kind") == 1).cast("int")).alias("_alone"))
    pages = F.greatest(F.max(F.when(F.col("stamp") == "", F.col("either"))).over(Window.partitionBy("doc")), F.lit(1))
    reach = lambda c, share: F.col(c) >= F.greatest(F.lit(float(STAMP_PAGES)), share * F.col("_pages"))
    out = out.withColumn("_pages", pages).filter("_alone = 1").withColumn("stripped", reach("either", STRIP_SHARE))
    return out.select("doc", "stamp", "alone", "either", (F.col("stripped") | reach("alone", ALONE_SHARE)).alias("dropped"), "stripped")


def laid_out(items: DataFrame) -> DataFrame:
    """Items in reading order (doc, ord, label, text, page, marker) without stamps and logos; ``ord`` is an array that sorts them.

    A chapter or annex heading that the page shows above everything read before it on that page goes in front of that.
    """
    own = items.filter(F.col("doc").isNotNull() & F.col("text").isNotNull()).select(
        "doc", "seq", F.coalesce("label", F.lit("text")).alias("label"), F.col("text").alias("raw"), "page", "top", F.coalesce("marker", F.lit("")).alias("marker"), F.coalesce("in_picture", F.lit(False)).alias("pic"),
    )
    stamps = repeated_stamps(own.select("doc", "page", F.col("raw").alias("text"))).filter("dropped")
    per = stamps.groupBy("doc").agg(F.collect_set("stamp").alias("_gone"), F.collect_set(F.when(F.col("stripped"), F.col("stamp"))).alias("_cut"))  # few: each stands on 3 pages or more
    alone = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    ended = F.rtrim("raw")
    cut = F.coalesce(*[F.when(F.array_contains("_cut", last_words(ended, n)), F.left(ended, F.length(ended) - F.length(last_words(ended, n)) - 1)) for n in (3, 2, 1)], F.col("raw"))
    own = own.join(per, "doc", "left").filter(~F.coalesce(F.array_contains("_gone", alone), F.lit(False))).select("doc", "seq", "label", alone.alias("alone"), F.regexp_replace(cut, r"(?U)^\s+|\s+$", "").alias("raw"), "page", "top", "marker", "pic")

    by = Window.partitionBy("doc").orderBy("seq")
    known = has(F.col("alone"), CHAPTER) | has(F.col("alone"), ANNEX) | has(F.col("alone"), FOOTNOTE) | has(F.col("alone"), DELETED_MARK)
    after_bare = F.coalesce(F.lag(has(F.col("raw"), BARE_CHAPTER)).over(by), F.lit(False))
    kept = own.withColumn("_keep", ~F.col("pic") | (F.length("alone") >= PICTURE_CHARS) | known | after_bare).filter("_keep")

    text = clean(unescape(F.col("raw")))
    kept = kept.select("doc", "seq", "label", text.alias("text"), "page", "top", "marker")
    heading = (has(F.col("text"), ANNEX) & (F.length("text") < ANNEX_CHARS)) | (has(F.col("text"), CHAPTER) & (F.length("text") < CHAPTER_CHARS))
    turned = F.coalesce(~F.col("page").eqNullSafe(F.lag("page").over(by)), F.lit(False)) | (F.row_number().over(by) == 1)
    runs = kept.withColumn("_run", F.sum(turned.cast("int")).over(by))
    above = Window.partitionBy("doc", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = heading & F.coalesce(F.col("top") < F.min(F.coalesce(F.col("top").cast("double"), F.lit(float("-inf")))).over(above), F.lit(False))
    order = F.when(first, F.array(F.col("_run").cast("bigint"), F.lit(0).cast("bigint"), -F.col("seq").cast("bigint"))).otherwise(F.array(F.col("_run").cast("bigint"), F.lit(1).cast("bigint"), F.col("seq").cast("bigint")))
    return runs.select("doc", order.alias("ord"), "label", "text", "page", "marker")


# ---- kinds of items, and the body -------------------------------------------------------------------------

def body_rows(items: DataFrame) -> DataFrame:
    """The items that make up the outline, with what they are; ``kind`` is 'annex', 'note', 'end' or 'line'.

    Each annex opens a zone of its own. The body of the main zone starts at the first chapter, numbered paragraph, numbered list mark, preamble
    heading or long text outside a contents page, that of an annex at its heading; it ends at a signature or a distribution list.
    """
    t, n = F.col("text"), F.length("text")
    header = F.col("label") == "section_header"
    own = items.withColumns({"_annex": has(t, ANNEX), "_chapter": has(t, CHAPTER), "_para": has(t, PARA), "_header": header})
    noise = (t == "") | F.col("label").isin(*DROPPED_LABELS) | ((F.col("label") == "caption") & ~F.col("_annex")) | has(t, NOISE) | has(t, DOT_LEADER)
    own = own.filter(~noise)
    note = has(t, FOOTNOTE) & ((F.col("label") == "footnote") | (n < NOTE_CHARS))
    at_end = (n < ANNEX_CHARS) & has(t, ANNEX_AT_END) & ~has(t, ANNEX_REFERENCE)
    own = own.withColumn("kind", F.when(note, "note").when(F.col("_annex") | at_end, "annex").otherwise("line"))

    line = F.col("kind") == "line"
    by = Window.partitionBy("doc").orderBy("ord")
    own = own.withColumn("zone", F.sum((F.col("kind") == "annex").cast("int")).over(by))
    own = own.withColumn("_contents", line & F.col("_header") & has(t, CONTENTS))
    zone = Window.partitionBy("doc", "zone").orderBy("ord")
    listed = F.max(F.col("_contents").cast("int")).over(zone) == 1
    opens = F.col("_chapter") | ((F.col("marker") == "") & F.col("_para")) | has(F.col("marker"), r"^\d{1,3}\.$") | (F.col("_header") & has(t, PREAMBLE)) | (~F.col("_header") & ~listed & (n >= BODY_CHARS))
    own = own.withColumn("_open", (F.col("zone") > 0) | (F.max((line & ~F.col("_contents") & opens).cast("int")).over(zone) == 1))
    heads = F.when(line & F.col("_open") & F.col("_header"), F.col("_contents"))
    own = own.withColumn("_body", line & F.col("_open") & ~F.coalesce(F.last(heads, ignorenulls=True).over(zone), F.lit(False)))
    ends = F.col("_body") & (((n < SIGNATURE_CHARS) & has(t, SIGNATURE)) | has(t, DISTRIBUTION))
    own = own.withColumn("_ends", F.sum(ends.cast("int")).over(zone))
    own = own.withColumn("kind", F.when(ends & (F.col("_ends") == 1), "end").otherwise(F.col("kind")))
    own = own.filter((F.col("kind") != "line") | (F.col("_body") & (F.col("_ends") == 0)))

    sub = F.when((n < TITLE_CHARS) & F.col("label").isin("section_header", "text"), part(t, SUBSECTION, 1)).otherwise("")
    section = has(t, SECTION)
    ident = F.when(F.col("kind") == "annex", F.when(F.col("_annex"), part(t, ANNEX, 1)).otherwise(part(t, ANNEX_AT_END, 1))).when(F.col("kind") == "note", part(t, FOOTNOTE, 1)).otherwise(part(t, CHAPTER, 1))
    rest = F.when(F.col("kind") == "annex", F.when(F.col("_annex"), F.regexp_replace(t, "(?U)" + ANNEX, "")).otherwise("")).when(F.col("kind") == "note", F.trim(part(t, FOOTNOTE, 2))).otherwise(part(t, CHAPTER, 2))
    mixed = has(t, INLINE_CHAPTER) | (~has(F.concat_ws(" ", F.nullif("marker", F.lit("")), t), PARA) & has(t, INLINE_PARA))
    return own.select(
        "doc", "ord", "kind", t.alias("text"), "page", "marker", ident.alias("ident"), rest.alias("rest"), (F.col("_chapter") & (n < CHAPTER_CHARS)).alias("is_chapter"),
        ((n < TITLE_CHARS) & ~F.col("_para") & ~section & ~has(t, SUBSECTION)).alias("may_name"), sub.alias("sub"), (F.col("_header") & section).alias("is_section"),
        (F.col("_header") & ~F.col("_para") & has(t, PREAMBLE)).alias("is_preamble"), F.col("_header").alias("is_header"), mixed.alias("is_mixed"),
    )


# ---- the outline ------------------------------------------------------------------------------------------

_CHAPTER, _PARA, _NUMBER = re.compile(CHAPTER), re.compile(PARA), re.compile(PARA_NUMBER)
_INLINE_CHAPTER, _INLINE_PARA, _REFERENCE = re.compile(INLINE_CHAPTER), re.compile(INLINE_PARA), re.compile(REFERENCE_WORD)
_SUBCLAUSE, _END = re.compile(SUBCLAUSE), re.compile(SENTENCE_END)
DASHES = " -–:"


@dataclass
class Block:
    """A paragraph, or a stretch of text without a number. ``raw`` are its lines as read: (text, page, starts a line)."""

    region: str
    chapter: str | None
    section: str | None
    para: str | None = None
    heading: str | None = None
    warning: str | None = None
    raw: list[tuple[str, int | None, bool]] = field(default_factory=list)
    lines: list[tuple[str, frozenset[int]]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    @property
    def annex(self) -> str | None:
        return None if self.region == "main" else "Annex " + self.region.removeprefix("annex_")


@dataclass
class Outline:
    """What the next row depends on."""

    blocks: list[Block] = field(default_factory=list)
    notes: list[tuple[str, str, int | None, Block]] = field(default_factory=list)
    region: str = "main"
    chapter: str | None = None
    section: str | None = None
    root: str | None = None  # lettered section that takes subsections
    number: int = 0
    restart: bool = False  # the first chapter has just begun: numbers may start again
    line: int = 0
    bare: int = -9  # line whose chapter still wants a title

    def __post_init__(self):
        self.turn()

    @property
    def open(self) -> Block:
        return self.blocks[-1]

    def turn(self, **block) -> Block:
        self.blocks.append(Block(self.region, self.chapter, self.section, **block))
        return self.open

    def begin_chapter(self, ident: str, name: str) -> None:
        name = name.strip(DASHES)
        self.restart = self.restart or self.chapter is None
        self.chapter, self.section, self.root = f"Chapter {ident} - {name}".rstrip(" -"), None, None
        self.bare = self.bare if name else self.line
        self.turn()

    def name_chapter(self, row) -> None:
        self.chapter += (" " if self.chapter.endswith(("-", "–")) else " - ") + row.text.rstrip(":")
        self.open.chapter = self.chapter
        if row.text.endswith(("-", "–")):
            self.bare = self.line

    def begin_section(self, name: str, root: bool = False) -> None:
        self.section = name
        self.root = name if root else self.root
        self.turn()

    def begin_annex(self, ident: str, rest: str) -> None:
        rest = rest.strip(DASHES) or None
        self.region, self.chapter, self.section, self.root = f"annex_{ident}", None, rest, rest
        self.number, self.restart, self.bare = 0, False, -9
        self.turn()


#: Which step from the last paragraph number to the next one is taken: (name, test of (step, last, has a suffix, may restart)).
STEPS: list[tuple[str, Callable[[int, int, bool, bool], bool]]] = [
    ("lettered", lambda step, last, lettered, restart: lettered and step in (0, 1)),
    ("next", lambda step, last, lettered, restart: not lettered and step == 1),
    ("first", lambda step, last, lettered, restart: not lettered and last == 0 and step == 2),
    ("restart", lambda step, last, lettered, restart: not lettered and restart and last > 0 and last + step == 1),
    ("gap", lambda step, last, lettered, restart: not lettered and last > 0 and step == 2),
]


def next_step(number: int, lettered: bool, last: int, restart: bool) -> str | None:
    return next((name for name, fits in STEPS if fits(number - last, last, lettered, restart)), None)


def take_number(o: Outline, text: str, row) -> bool:
    """Whether ``text`` opens the next paragraph; if so it is opened."""
    m = _PARA.match(text)
    step = next_step(int(m[1]), bool(m[2]), o.number, o.restart) if m else None
    if step is None:
        return False
    warning = f"{o.region} para {m[1]} follows {o.number} on page {row.page}" if step == "gap" else None
    if step == "restart":  # what was numbered before the first chapter belongs to the preamble
        for b in o.blocks:
            if b.region == o.region and b.chapter is None:
                b.para = None
    o.number, o.restart = int(m[1]), False
    o.turn(para=m[1] + (m[2] or ""), heading=_NUMBER.sub("", text).rstrip(":") if row.is_header else None, warning=warning).raw.append((text, row.page, True))
    return True


def take_text(o: Outline, row) -> None:
    """Text of the body, cut at chapters and at the next paragraph number where it runs on in one item."""
    text = f"{row.marker} {row.text}" if row.marker else row.text
    for piece in runs_on(text, o) if row.is_mixed else [text]:
        m = _CHAPTER.match(piece) if row.is_mixed and len(piece) < CHAPTER_CHARS else None
        if m:
            o.begin_chapter(m[1], m[2])
        elif not take_number(o, piece, row):
            o.open.raw.append((piece, row.page, False))


def runs_on(text: str, o: Outline):
    """The pieces of an item; each is given out before the next one is looked for, as the number sought depends on it."""
    for segment in filter(None, _INLINE_CHAPTER.split(text)):
        buried = () if _PARA.match(segment) else _INLINE_PARA.finditer(segment)
        at = next((m.start() for m in buried if int(m[1]) == o.number + 1 and not _REFERENCE.search(segment[: m.start()])), len(segment))
        yield from filter(None, (segment[:at].strip(), segment[at:].strip()))


def _nests(o: Outline, row) -> str:
    name = row.text.rstrip(":").strip()
    return f"{o.root} › {name}" if o.root and o.root.startswith(row.sub + ".") else name


#: What a row does to the outline: the first rule whose test holds. Rows are tested in the order of the table.
RULES: list[tuple[str, Callable[[Outline, object], bool], Callable[[Outline, object], object]]] = [
    ("note", lambda o, r: r.kind == "note", lambda o, r: o.notes.append((r.ident, r.rest, r.page, o.open))),
    ("annex", lambda o, r: r.kind == "annex", lambda o, r: o.begin_annex(r.ident, r.rest)),
    ("end of body", lambda o, r: r.kind == "end", lambda o, r: o.turn()),
    ("chapter", lambda o, r: r.is_chapter, lambda o, r: o.begin_chapter(r.ident, r.rest)),
    ("title of the chapter before", lambda o, r: r.may_name and o.bare == o.line - 1 and not o.open.raw, Outline.name_chapter),
    ("subsection", lambda o, r: r.sub != "", lambda o, r: o.begin_section(_nests(o, r))),
    ("section", lambda o, r: r.is_section, lambda o, r: o.begin_section(r.text.rstrip(":").strip(), root=True)),
    ("preamble", lambda o, r: r.is_preamble and o.open.para is None, lambda o, r: o.begin_section(r.text.rstrip(":"))),
    ("text", lambda o, r: True, take_text),
]


def outline(rows) -> list[Block]:
    """The blocks of one document's ``body_rows`` in order, with their lines joined and their notes attached."""
    o = Outline()
    for row in rows:
        o.line += row.kind == "line"
        next(act for _, fits, act in RULES if fits(o, row))(o, row)
    blocks = [b for b in o.blocks if b.raw]
    for b in blocks:
        b.lines = joined(b.raw)
    attach_notes(o.notes, blocks)
    return blocks


def joined(raw: list[tuple[str, int | None, bool]]) -> list[tuple[str, frozenset[int]]]:
    """Lines of a block: a text goes on with the line before it unless that ended a sentence or the text opens a clause."""
    lines: list[tuple[list[str], set[int]]] = []
    for text, page, fresh in raw:
        if not lines or fresh or _END.search(lines[-1][0][-1]) or _SUBCLAUSE.match(text) or text.startswith("•"):
            lines.append(([], set()))
        lines[-1][0].append(text)
        lines[-1][1].update(() if page is None else (page,))
    return [(" ".join(texts), frozenset(pages)) for texts, pages in lines]


def attach_notes(notes: list[tuple[str, str, int | None, Block]], blocks: list[Block]) -> None:
    """Each note goes to the last block on its page, or ending on the page before, that shows its mark, which is taken out; without one to
    the block that was open when it was read, else to the last one."""
    spans = [(sorted(frozenset().union(*(p for _, p in b.lines))), b) for b in blocks]
    for number, note, page, current in notes:
        mark = re.compile(FOOTNOTE_MARK.format(n=number), re.M)
        near = [b for pages, b in spans if page is not None and pages and pages[0] <= page <= pages[-1] + 1]
        home = next((b for b in reversed(near) if any(mark.search(t) for t, _ in b.lines)), None)
        if home is not None:
            home.lines = [(mark.sub(lambda m: "[" if m[0].startswith("[") else "", t), p) for t, p in home.lines]
        elif blocks:
            home = current if current.raw else blocks[-1]
        else:
            continue
        home.notes.append(note)


def shortened(text: str, limit: int) -> str:
    return text if len(text) <= limit else text[:limit].rsplit(" ", 1)[0] + "…"


def title_of(b: Block) -> str:
    """What a block is about: its heading's words, as far as there are any."""
    if b.para is None:
        return b.section or b.chapter or (f"{b.annex} (preamble)" if b.annex else "Preamble")
    texts = [_NUMBER.sub("", t) if i == 0 else t for i, (t, _) in enumerate(b.lines[:2])]
    first = next(filter(None, texts), "")
    before, colon, _ = first.partition(":")
    if colon and 0 < len(before) <= 150:
        return before.strip(" -–")
    return b.heading or (first.rstrip(".") if len(first) <= 100 else shortened(first, 100))
