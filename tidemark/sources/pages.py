"""Pages of a disclosure site as rows: listings, viewer headers and sections, in Arrow batches over an HTML column.

Each reader turns one page into rows. A page that does not have the expected shape gives one row that has only `error`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import html_tables

#: What the listing table, its marks and the empty choices of the viewer are called.
LISTING_WORDS = ("회사명", "공시제목")
CORRECTED_LATER = "해당보고서 이후에 정정된 보고서 있음"
CORRECTION = "정정"
EMPTY_CHOICES = {"mainDoc": "본문선택", "attachedDoc": "첨부문서선택"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A tag that opens ends the open ones on the right of it, up to the nearest of the others.
ENDS = {"tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "li": ({"li"}, {"ul", "ol"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
ENDS |= dict.fromkeys("p h1 h2 h3 h4 h5 h6 div ul ol table section".split(), ({"p"}, {"body", "div", "td", "th", "li", "table", "section"}))


class Node:
    """An element with its place in the page: `start` of its first tag."""

    __slots__ = ("tag", "attrs", "inside", "start")

    def __init__(self, tag: str, attrs: dict[str, str], start: int) -> None:
        self.tag, self.attrs, self.inside, self.start = tag, attrs, [], start

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.inside) if isinstance(c, Node)]

    def all(self, tag: str, **attrs: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.tag == tag and all(n.attrs.get(k) == v for k, v in attrs.items())]

    def direct(self, tag: str) -> list[Node]:
        return [c for c in self.inside if isinstance(c, Node) and c.tag == tag]

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                todo += reversed(node.inside)
        return clean("".join(parts))


def clean(text: str | None) -> str:
    return " ".join((text or "").split())


class _Reader(HTMLParser):
    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        for m in re.finditer("\n", page):
            self.lines.append(m.end())
        self.root = Node("", {}, 0)
        self.path = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended, within = ENDS.get(tag, ((), ()))
        at = len(self.path) - 1
        last = None
        while at > 0 and self.path[at].tag not in within:
            if self.path[at].tag in ended:
                last = at
            at -= 1
        if last is not None:
            del self.path[last:]
        line, column = self.getpos()
        node = Node(tag, {k: v or "" for k, v in attrs}, self.lines[line - 1] + column)
        self.path[-1].inside.append(node)
        if tag not in VOID:
            self.path.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.path[-1].tag == tag and tag not in VOID:
            self.path.pop()

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.path) - 1, 0, -1):
            if self.path[at].tag == tag:
                del self.path[at:]
                return

    def handle_data(self, data: str) -> None:
        self.path[-1].inside.append(data)


def _need(value, what: str):
    if not value:
        raise ValueError(what)
    return value


def _call(name: str, node: Node) -> list[str]:
    hit = re.search(name + r"\(([^)]*)\)", node.attrs.get("onclick", ""))
    return [a.strip().strip("'\"").strip() for a in hit.group(1).split(",")] if hit else []


def listing(page: str) -> list[tuple]:
    """Rows of the one listing table: five cells at least, one link to a disclosure, at most one to a company."""
    found = [t for t in _Reader(page).root.all("table") if all(w in t.attrs.get("summary", "") for w in LISTING_WORDS)]
    if len(found) != 1 or len(found[0].direct("tbody")) != 1:
        raise ValueError("not one listing table with one body")
    out = []
    for n, tr in enumerate(found[0].direct("tbody")[0].direct("tr"), start=1):
        cells = tr.direct("td")
        if len(cells) < 5:
            raise ValueError(f"row {n} has fewer than 5 cells")
        links = [a for a in cells[3].all("a") if "openDisclsViewer" in a.attrs.get("onclick", "")]
        firms = cells[2].all("a", id="companysum")
        if len(links) != 1 or len(firms) > 1:
            raise ValueError(f"row {n} has {len(links)} disclosure links and {len(firms)} company links")
        name = code = None
        if firms:
            name = _need(clean(firms[0].attrs.get("title")), f"row {n} has a company link without a title")
            code = _need((_call("companysummary_open", firms[0]) or [""])[0], f"row {n} has a company link without an id")
        marks = [_need(clean(i.attrs.get("alt")), f"row {n} has an image without a label") for i in cells[2].all("img")]
        call = _call("openDisclsViewer", links[0])
        acpt = _need(call and call[0], f"row {n} has no acpt_no")
        title = _need(links[0].text(), f"row {n} has no title")
        flags = list(dict.fromkeys(f for f in (clean(x) for x in re.findall(r"\[([^\[\]]+)\]", title)) if f))
        later = any(clean(i.attrs.get("alt")) == CORRECTED_LATER for i in cells[3].all("img"))
        base = clean(links[0].attrs.get("title"))
        doc = call[1] if len(call) > 1 else None
        out.append((n, cells[0].text(), name, code, cells[2].text(), marks[0] if marks else None, marks[1:], cells[1].text(), title, base, flags, CORRECTION in flags, later, acpt, doc, cells[4].text()))
    return out


LISTING = "at int, row_no string, company_name string, company_id string, company_cell_text string, market string, badges array<string>, disclosed_at string, title string, title_base string, title_flags array<string>, is_correction_report boolean, has_later_correction boolean, acpt_no string, doc_no string, submitter string"


def viewer(page: str, strict: bool = False) -> list[tuple]:
    """One row: acpt_no, heading, title, the documents of both choices and the chosen one. `strict`: all must be there."""
    root = _Reader(page).root
    value = lambda name: next((i.attrs.get("value", "").strip() for i in root.all("input", name=name)), "")
    heads = [h for h in root.all("h1") if "ttl" in h.attrs.get("class", "").split()]
    docs: dict[str, list[tuple]] = {}
    for choice, empty in EMPTY_CHOICES.items():
        boxes = root.all("select", id=choice)
        docs[choice] = []
        for at, option in enumerate(boxes[0].all("option") if boxes else []):
            raw = option.attrs.get("value", "").strip()
            number, _, flag = raw.partition("|")
            flag, chosen, label = flag.strip().upper(), "selected" in option.attrs, option.text()
            docs[choice].append((number.strip(), label, chosen, flag == "Y" if flag else None))
            if strict and not number.strip() and not (at == 0 and not raw and not chosen and label == empty):
                raise ValueError(f"option {at} of {choice} has no number")
        if strict:
            _need(docs[choice], f"{choice} has no options")
    chosen = next((d[0] for d in docs["mainDoc"] if d[2]), None)
    acpt = value("acptNo") or None
    if strict:
        _need(acpt, "no acptNo")
        _need(chosen, "no chosen mainDoc")
    return [(acpt, heads[0].text() if heads else "", value("tempTitle"), docs["mainDoc"], docs["attachedDoc"], chosen)]


_DOCS = "array<struct<doc_no: string, label: string, selected: boolean, is_latest: boolean>>"
VIEWER = f"acpt_no string, header string, title string, main_docs {_DOCS}, attached_docs {_DOCS}, selected_main_doc_no string"


def sections(page: str) -> list[tuple]:
    """(index, title, html) between the headings of a class SECTION-n that lie directly in the body."""
    root = _Reader(page).root
    bodies = root.all("body")
    if not bodies or not root.all("head"):
        raise ValueError("no head or no body")
    direct = [c for c in bodies[0].inside if isinstance(c, Node)]
    starts = [i for i, c in enumerate(direct) if re.fullmatch("h[1-6]", c.tag) and any(re.fullmatch(r"SECTION-[0-9]+", k) for k in c.attrs.get("class", "").split())]
    _need(starts, "no section heading")
    end = re.search(r"</body\s*>", page, re.I)
    ends = [direct[i].start for i in starts[1:]] + [end.start() if end else len(page)]
    out = []
    for n, (i, stop) in enumerate(zip(starts, ends, strict=True), start=1):
        title = direct[i].text()
        if not title and i + 1 < len(direct) and direct[i + 1].tag == "p" and direct[i + 1].start < stop:
            title = direct[i + 1].text()
        out.append((n, _need(title, f"section {n} has no title"), page[direct[i].start : stop]))
    return out


SECTIONS = "index int, title string, html string"


def read_pages(docs: DataFrame, id_col: str, html_col: str, reader: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """(id, the reader's columns, error) by Arrow batches, given back in slices by bytes of HTML; a null page reads as an empty one."""
    kind = dict(docs.dtypes)[id_col]
    names = [id_col, *[f.split()[0] for f in re.split(r",\s*(?![^<]*>)", schema)], "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for ident, page in zip(batch[id_col], batch[html_col], strict=True):
                try:
                    out += [(ident, *row, None) for row in reader(page or "")]
                except ValueError as e:
                    out.append((ident, *[None] * (len(names) - 2), str(e)))
                size += len(page or "")
                if size >= html_tables.SLICE_BYTES:
                    yield pd.DataFrame(out, columns=names, dtype=object)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names, dtype=object)

    return docs.select(id_col, html_col).mapInPandas(run, f"`{id_col}` {kind}, {schema}, error string")


def signatures(found: DataFrame, id_col: str) -> DataFrame:
    """(id, signature): toc_1, its title, toc_2 and so on, of a document's sections."""
    part = F.concat(F.lit("toc_"), F.col("index"), F.lit(" "), F.col("title"))
    return found.filter("error IS NULL").groupBy(id_col).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("index", part.alias("t")))), lambda x: x["t"])).alias("signature"))


def signature_facet(signed: DataFrame) -> DataFrame:
    """(signature, n): how many documents have each."""
    return signed.groupBy("signature").agg(F.count("*").alias("n"))


def document_paths(html: Column) -> Column:
    """The five arguments of the call of setPath, as a struct; null without one."""
    names = ("toc_loc_path", "doc_loc_path", "doc_server_path", "form_upclss_cd", "snd_loc_tp_cd")
    call = r"parent\.setPath\(\s*" + r"\s*,\s*".join(["'([^']*)'"] * len(names)) + r"\s*\)"
    return F.when(html.rlike(call), F.struct(*[F.regexp_extract(html, call, i).alias(n) for i, n in enumerate(names, start=1)]))


def fingerprint(html: Column) -> Column:
    """(sha256, size) of a page's bytes."""
    return F.struct(F.sha2(html.cast("binary"), 256).alias("sha256"), F.octet_length(html).alias("size"))


def choose_sections(found: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """(id, status, rule, chosen, content) of documents whose sections (id, index, title, html) a rule tells which to keep.

    rules: (rule, signature, toc_ids). A signature is a whole one as of signatures(), or, with "*" behind it, the headings one begins with; of the rules
    that fit a document the smallest holds. content joins the html of the kept sections in order by line breaks. Without a rule the status is
    missing_selection. Every beginning of every distinct signature meets the rules by equality, so rules may be many.
    """
    part = F.concat(F.lit("toc_"), F.col("index"), F.lit(" "), F.col("title"))
    kept = F.struct("index", part.alias("t"), F.coalesce("html", F.lit("")).alias("html"))
    docs = found.filter("error IS NULL").groupBy(id_col).agg(F.array_sort(F.collect_list(kept)).alias("s")).withColumn("parts", F.transform("s", lambda x: x["t"]))
    begun = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.concat_ws(" ", F.slice("parts", 1, n)))
    kinds = docs.select("parts").distinct().select("parts", F.posexplode(begun).alias("n", "start"))
    open_ = F.col("signature").endswith("*")
    asked = rules.select("rule", "toc_ids", open_.alias("open"), F.when(open_, F.rtrim(F.expr("left(signature, length(signature) - 1)"))).otherwise(F.col("signature")).alias("start"))
    fits = kinds.join(asked, "start").filter(F.col("open") | (F.col("n") == F.size("parts")))
    best = fits.groupBy("parts").agg(F.min(F.struct("rule", "toc_ids")).alias("r")).select(F.col("parts").alias("__p"), "r.*")
    out = docs.join(best, F.col("parts") == F.col("__p"), "left")
    chosen = F.filter("s", lambda x: F.array_contains("toc_ids", F.concat(F.lit("toc_"), x["index"])))
    known = F.col("rule").isNotNull()
    return out.select(id_col, F.when(known, "ok").otherwise("missing_selection").alias("status"), "rule", F.when(known, F.size(chosen)).alias("chosen"), F.when(known, F.array_join(F.transform(chosen, lambda x: x["html"]), "\n")).alias("content"))


def section_patterns(found: DataFrame, id_col: str, samples: int = 3) -> DataFrame:
    """(signature, count, section_count, samples) of documents' sections: most frequent first, then those of fewer sections, then by signature.

    samples are the smallest ids of each, cut before they are gathered, as an array.
    """
    size = found.filter("error IS NULL").groupBy(id_col).agg(F.count("*").alias("section_count"))
    signed = signatures(found, id_col).join(size, id_col).filter("signature <> ''")
    rank = F.row_number().over(Window.partitionBy("signature").orderBy(id_col))
    first = signed.withColumn("__r", rank).filter(F.col("__r") <= samples).groupBy("signature").agg(F.array_sort(F.collect_list(id_col)).alias("samples"))
    counted = signed.groupBy("signature").agg(F.count("*").alias("count"), F.min("section_count").alias("section_count"))
    return counted.join(first, "signature").orderBy(F.desc("count"), "section_count", "signature")


#: How a listing tells its total, the page and the number of pages.
PAGINATION = r"전체\s*<em>([\d,]+)</em>\s*건\s*:\s*<strong>([\d,]+)</strong>/([\d,]+)(?=[^\d,]|$)"


def pagination(html: Column) -> Column:
    """(total_items, current_page, total_pages) of a listing, or null where it does not tell."""
    part = lambda i: F.replace(F.regexp_extract(html, PAGINATION, i), F.lit(","), F.lit("")).try_cast("long")
    return F.when(html.rlike(PAGINATION), F.struct(part(1).alias("total_items"), part(2).alias("current_page"), part(3).alias("total_pages")))
