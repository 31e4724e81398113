"""Requirement extraction: a sequential scan per document, since a row may continue or own the lines before it.

Anchors (a line that is an identifier) own a block of lines; rows hold an identifier and its text; open rows go on over the lines
behind them; sentences with 'shall' or 'must' continue the requirement before them or, in documents without identifiers, stand for themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specforge.functions.text import any_of

# Forms of identifiers and of lines that aren't requirements.
ID = r"(?:(?:REF|APP|GEN)-[A-Z0-9][A-Z0-9_.-]{2,40}|REQ-\d{4,10})"
IDENTIFIER = re.compile(rf"\b({ID})\b")
ANCHOR = re.compile(rf"^\s*({ID})\b[\s.()A-Za-z0-9]{{0,12}}$")
ROW = re.compile(rf"^\s*{ID}\b[^|]{{0,20}}\|")
BROKEN = re.compile(r"\b(?:REF|APP|GEN)(?:\s*-\s*[A-Z0-9_.]{1,20}){2,}")
BINDING = re.compile(r"\b(?:shall|must)\b", re.I)
NOISE = re.compile(r"^(table of|figure \d|page \d|see |cf\.|nota\b|note\s*:)", re.I)
TABLE_HEADER = re.compile(r"requirement\s+number.*description\s+of\s+the\s+requirement", re.I)
META = re.compile(r"att_sdf@|psa_comments@|\{\{|\}\}", re.I)
EXAMPLE = re.compile(
    r"free to modify the example|it is mandatory to write a requirement|<do something>|<expected functional performance|shall\s*…\s*$"
    r"|the requirement engineering template shall|<\s*be made of", re.I,
)
HISTORY = re.compile(r"\b(new|removed|modified)\s+requirements?\s*:?\s*$", re.I)
REFERENCE = re.compile(r"\[?[A-Z0-9_ ,;/-]{1,40}\]?")
LOGIC = {"IF", "THEN", "ELSE", "SI", "ALORS", "AND", "OR", "ET", "OU", "NOT", "ENDIF", "ELSEIF"}
LONGEST, SHORTEST, ALONE = 600, 15, 30
#: Lines of a block; of a gap between a requirement and its continuation; that continue an open row; between two anchors of one requirement.
BLOCK, GAP, OPEN, TWIN = 30, 6, 12, 4


@dataclass
class Requirement:
    req_id: str
    text: str
    line_no: int

    def extend(self, more: str) -> None:
        self.text = f"{self.text} {more}".strip()[:LONGEST]


def rejoined(text: str) -> str:
    """Identifiers with white space inside, put together again."""
    return BROKEN.sub(lambda m: "".join(m[0].split()), text)


def cell(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip(" |·-–—\t")


def description(cells: list[str]) -> str:
    """The longest binding cell of 15 characters or more, else the longest."""
    long = [c for c in cells if len(c) >= SHORTEST]
    return max([c for c in long if BINDING.search(c)] or long, key=len, default="")


def begins_something(line: str, noise: bool = False) -> bool:
    """A line that can't continue a cell: an anchor, a row, a table header, a history heading or one in capitals."""
    capitals = line == line.upper() and len(line) > 3 and any(c.isalpha() for c in line) and line not in LOGIC
    return bool(capitals or ANCHOR.match(line) or ROW.match(line) or TABLE_HEADER.search(line) or HISTORY.search(line) or (noise and NOISE.match(line)))


@dataclass
class Scan:
    """The state of one document's scan."""

    lines: list[str]
    found: list[Requirement] = field(default_factory=list)
    known: dict[str, Requirement] = field(default_factory=dict)
    texts: set[str] = field(default_factory=set)
    owner: dict[int, Requirement | None] = field(default_factory=dict)  # lines that are used up, and whose they are
    loose: list[Requirement] = field(default_factory=list)
    last: Requirement | None = None
    upto: int = -10

    def add(self, req_id: str, text: str, line: int) -> None:
        text = " ".join(text.split())[:LONGEST]
        if EXAMPLE.search(text):
            return
        text = "" if HISTORY.search(text) else text
        if req_id in self.known:
            self.known[req_id].text = self.known[req_id].text or text
            return
        key = re.sub(r"\W+", "", text.lower())[:120]
        if not req_id and (not text or key in self.texts):
            return
        made = Requirement(req_id, text, line + 1)
        self.found.append(made)
        if req_id:
            self.known[req_id] = made
        else:
            self.texts.add(key)

    # ------------------------------------------------------------ blocks of anchors
    def blocks(self) -> None:
        anchors = [(k, m[1]) for k, line in enumerate(self.lines) if (m := ANCHOR.match(line.strip()))]
        twin = [False] + [a[1].startswith("REQ-") and not b[1].startswith("REQ-") and b[0] - a[0] <= TWIN for a, b in zip(anchors, anchors[1:], strict=False)]
        for n, (k, req_id) in enumerate(anchors):
            if twin[n]:
                continue
            if self.mentioned(k):
                self.add(req_id, "", k)
                self.owner[k] = None
                continue
            inner = n + 1 < len(anchors) and twin[n + 1]
            later = next((anchors[j][0] for j in range(n + 1, len(anchors)) if not twin[j]), len(self.lines))
            end = min(later, k + 1 + BLOCK)
            end = next((j for j in range(k + 1 + 2 * inner, end) if ROW.match(self.lines[j])), end)
            self.add(req_id, self.labelled(req_id, self.lines[k + 1 : end]), k)
            self.owner.update(dict.fromkeys(range(k, end), self.known.get(req_id)))

    def mentioned(self, k: int) -> bool:
        """Listed under a heading of the change history: the nearer of the two lines above that isn't blank."""
        above = [s for j in (k - 1, k - 2) if j >= 0 and (s := self.lines[j].strip())]
        return bool(above and HISTORY.search(above[0]))

    @staticmethod
    def labelled(req_id: str, block: list[str]) -> str:
        """Description of a block, behind its internal number."""
        joined = "\n".join(x for x in block if not TABLE_HEADER.search(x))
        inner = IDENTIFIER.search(joined)
        parts = [re.sub(r"\s+", " ", x).strip(" ·-–—\t") for x in joined.split("|")]
        text = description([x for x in parts if not META.search(x) and not REFERENCE.fullmatch(x)])
        return f"[{inner[1]}] {text}" if text and inner and inner[1] != req_id else text

    # ------------------------------------------------------------ rows and sentences
    def walk(self) -> None:
        k = 0
        while k < len(self.lines):
            line = self.lines[k].strip()
            if k in self.owner:
                if self.owner[k] is not None:
                    self.last, self.upto = self.owner[k], k
            elif line and not NOISE.match(line):
                if IDENTIFIER.search(line):
                    k = self.row(k, line)
                elif BINDING.search(line) and line.count("|") < 2:
                    self.sentence(k, line)
            k += 1

    def row(self, k: int, line: str) -> int:
        """A line with identifiers: those up to the description's cell are its own, else those behind it.  Returns the last line that it used."""
        raw = line.split("|")
        cells = [cell(IDENTIFIER.sub(" ", x)) for x in raw]
        text = description(cells)
        at = cells.index(text) if text else len(raw)
        ids = [(n, x) for n, part in enumerate(raw) for x in IDENTIFIER.findall(part)]
        own = [x for n, x in ids if n <= at] or [x for _, x in ids]
        for req_id in own:
            self.add(req_id, text, k)
        req = self.known.get(own[0])
        if req is None or req.line_no != k + 1:
            return k
        end = self.continued(k, req) if at >= len(raw) - 1 else k
        self.last, self.upto = req, end
        return end

    def continued(self, k: int, req: Requirement) -> int:
        """The lines behind an open cell up to a boundary or to the bar that closes it."""
        j, taken = k + 1, 0
        while j < len(self.lines) and taken < OPEN:
            line = self.lines[j].strip()
            if line:
                if j in self.owner or begins_something(line):
                    break
                head, bar, rest = line.partition("|")
                if bar:
                    head = cell(head)
                    if IDENTIFIER.search(rest) and not rest.lstrip().startswith("["):
                        break
                    if head and not IDENTIFIER.search(head):
                        req.text = f"{req.text} {head}"[:LONGEST]
                        self.owner[j] = None
                        j += 1
                    break
                req.extend(line)
                self.owner[j] = None
                taken += 1
            j += 1
        return j - 1

    def sentence(self, k: int, line: str) -> None:
        text = description([cell(x) for x in line.split("|")])
        if not text:
            return
        gap = self.gap(self.upto + 1, k) if self.last is not None and "|" not in line else None
        if gap is not None:
            self.last.extend(" ".join([*gap, text]))
            for j in range(self.upto + 1, k + 1):
                self.owner.setdefault(j, None)
            self.upto = k
        elif len(text) >= ALONE:
            self.loose.append(Requirement("", text, k))

    def gap(self, begin: int, end: int) -> list[str] | None:
        """Plain lines between the last requirement and a sentence, or None if something separates them."""
        between = [(j, s) for j in range(begin, end) if (s := self.lines[j].strip())]
        apart = any(j in self.owner or "|" in s or IDENTIFIER.search(s) or begins_something(s) for j, s in between)
        return None if end - begin > GAP or apart else [s for _, s in between]


def extract(text: str) -> list[Requirement]:
    scan = Scan(rejoined(text).split("\n"))
    scan.blocks()
    scan.walk()
    if not scan.known:
        for r in scan.loose:
            scan.add("", r.text, r.line_no)
    return scan.found


def extract_requirements(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, req_id, text, line_no from 1) of documents (doc_id, text): narrow, one document at a time."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, r.req_id, r.text, r.line_no) for d, t in zip(batch.doc_id, batch.text, strict=True) for k, r in enumerate(extract(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "req_id", "text", "line_no"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(scan, "doc_id long, seq int, req_id string, text string, line_no int")


def inline_requirements(lines: DataFrame) -> DataFrame:
    """The part that needs no scan: table rows that begin with an identifier; first row of each identifier."""
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    rows = lines.withColumn("cells", cells).where(F.get("cells", F.lit(0)).rlike(r"^(?:REQ|REF|APP|GEN)(?:-[A-Z0-9_]+)*-\d+$") & (F.size("cells") >= 2))
    named = rows.select("doc_id", F.get("cells", F.lit(0)).alias("req_id"), F.get("cells", F.lit(1)).alias("text"), "line_no")
    return named.groupBy("doc_id", "req_id").agg(F.min_by("text", "line_no").alias("text"), F.min("line_no").alias("line_no"))


def matrix_rows(found: DataFrame, first_row: int = 10) -> DataFrame:
    """Rows of the generated matrix: description in column A, identifier in column C."""
    return found.select("doc_id", (F.col("seq") + first_row).alias("row"), F.col("text").alias("col_a"), F.col("req_id").alias("col_c"))


# ---------------------------------------------------------------- requirement tables
# Headers of the columns of requirement tables, words of other tables, words of requirements.
COLUMNS = {
    "req_id": (
        r"req(?:uirement)?\s*(?:no\.?|number|num(?:éro)?|id|#)", r"(?:no\.?|number|num(?:éro)?)\s*(?:of\s*)?(?:the\s*)?req(?:uirement)?", r"^req(?:uirement)?\s*$",
        r"identif", r"^(?:no\.?|n[°º])\s*(?:\([^)]*\))?\s*$",
    ),
    "description": (r"desc(?:ription)?", r"(?:functional\s*)?req(?:uirement)?\s*(?:description|text)", r"^description$"),
    "input_requirement": (r"input\s*req(?:uirement)?", r"upstream\s*req(?:uirement)?", r"(?:amont|entrante)"),
}
OTHER_TABLES = ("mark", "reference", "version", "title", "link", "document", "author", "date", "signature", "inspector", "approved", "co-author", "index", "modification", "status", "complexity", "variant")
LIKE_REQUIREMENT = r"(?i)\b(shall|must|will|if|when|then|system|component|function)\b"


def table_requirements(tables: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_index, section, req_id, description, input_requirement) of table rows (doc_id, table_index, row_index from 0, section, cells).

    Row 0 is the header.  A requirement table has a description column, a column of identifiers or upstream requirements, three columns
    or more and no column 'Mark'; without identifiers its first rows must read like requirements.  Of an identifier only what stands before
    a line end or an '@' counts.
    """

    def place(field_: str):
        earlier = list(COLUMNS)[: list(COLUMNS).index(field_)]

        def test(c):
            out = any_of(c, [f"(?i:{p})" for p in COLUMNS[field_]])
            for f in earlier:
                out = out & ~any_of(c, [f"(?i:{p})" for p in COLUMNS[f]])
            return out

        numbered = F.transform("cells", lambda c, i: F.when(test(c), i).otherwise(-1))
        return F.array_max(numbered)

    heads = tables.where("row_index = 0")
    joined = F.lower(F.array_join("cells", " | "))
    metadata = sum((F.contains(joined, F.lit(w)).cast("int") for w in OTHER_TABLES), F.lit(0))
    heads = heads.select("doc_id", "table_index", F.size("cells").alias("width"), F.exists("cells", lambda c: c.rlike(r"(?i)^\s*mark\s*$")).alias("mark"), metadata.alias("metadata"), *[place(f).alias(f"at_{f}") for f in COLUMNS])
    heads = heads.where("not mark and not (metadata >= 2 and width <= 4) and width > 2 and at_description >= 0 and (at_req_id >= 0 or at_input_requirement >= 0)")
    at = lambda f: F.when(F.col(f"at_{f}") >= 0, F.coalesce(F.get("cells", F.col(f"at_{f}")), F.lit("")))
    first = F.trim(F.element_at(F.split(F.trim(F.element_at(F.split(at("req_id"), "\n"), 1)), "@"), 1))
    rows = tables.where("row_index > 0").join(heads, ["doc_id", "table_index"])
    rows = rows.select("doc_id", "table_index", "row_index", "section", "at_req_id", first.alias("req_id"), at("description").alias("description"), at("input_requirement").alias("input_requirement"))
    sample = (F.col("row_index") <= 3) & (F.char_length("description") > 10)
    seen = rows.where("at_req_id < 0").groupBy("doc_id", "table_index").agg(F.count_if(sample).alias("sampled"), F.count_if(sample & F.col("description").rlike(LIKE_REQUIREMENT)).alias("alike"))
    prose = seen.where("sampled > 0 and alike = 0").select("doc_id", "table_index")
    kept = rows.join(prose, ["doc_id", "table_index"], "left_anti")
    return kept.where("coalesce(description, '') <> '' or coalesce(req_id, '') <> ''").drop("at_req_id")
