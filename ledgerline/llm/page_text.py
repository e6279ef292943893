"""Main text of web pages by differencing with the page of the nearest URL.

A page becomes lines: the text of its blocks, with character references decoded
and white space collapsed. Scripts, styles, templates, forms and comments of the
markup give none. A line lies in the article (an article or main element), in
furniture (menus, headers, footers, asides, and blocks that name themselves so),
or is a candidate. What is marked around an article doesn't silence it, unless
the page has another article in fewer parts such as asides and comments.

Within each host every page is compared with the page of the nearest URL path
whose article and candidates are not the same: all lines of both are aligned by
longest common subsequence, and lines that the two share are deleted. Only prose
of an article is no furniture for being shared: articles quote each other and are
published twice, so in an article shared lines go if they are links for the most
part. Furniture that no neighbour shares goes by its markup. The text of a page
is what is left of its article, or of its candidates if it has none.

Pages are parsed once and compared by hashes of their lines. They are put in
order of (host, path, page_id) over range partitions, so a large host spreads over
many of them, and each page is compared with the nearest different ones before and
after in that order. A partition's first and last pages meet theirs too, from however
many partitions away: one page for each side of a partition is looked up and sent there,
so copies of a page may fill partitions, and the result doesn't depend on how pages are dealt.

Null or empty html gives an empty text. Pages without a host, or alone on it, are
not compared. Repeated rows each get a result.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept, map_batches

#: Elements whose content is never text of the page.
SILENT = {"script", "style", "noscript", "template", "form", "svg", "iframe", "title", "select", "button", "textarea", "object", "canvas"}
#: Those whose content is no markup, so that an article in it is none.
RAW = {"script", "style", "noscript", "template", "title", "iframe", "textarea"}
#: Elements that end an open paragraph, and elements that end an open one of their own kind.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dd", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
#: Elements around the main text, and elements that hold page furniture.
MAIN, FURNITURE = {"article", "main"}, {"nav", "header", "footer", "aside", "menu", "dialog"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|legal|menu|modal|nav(?:bar|igation)?|newsletter|notices?|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_STATE = re.compile(r"(?:no|not|with|without|has|have)[-_]", re.IGNORECASE)
_ONE_WORD = re.compile(r"[a-z]+", re.IGNORECASE)
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+\Z")
_ARTICLE = re.compile(r"<(?:article|main)\b", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
#: What a line is; the last two are lines of an article, of prose and of links.
CANDIDATE, FURNISHED, ARTICLE, LINKS = 0, 1, 2, 3
#: Cells of a table of common subsequences up to which it is held whole.
TABLE_CELLS = 4_000_000


def _mark(attributes: str) -> str:
    """What class, id and role say of an element: nothing, marked, or strong (a word alone, not a part of a longer name)."""
    if "=" not in attributes:
        return ""
    names = [t for m in _MARK.findall(attributes) for x in m for t in x.split() if not _STATE.match(t) and MARKED.search(t)]
    return "strong" if any(_ONE_WORD.fullmatch(t) for t in names) else "marked" if names else ""


def lines(page: str) -> list[tuple[str, int]]:
    """The page's lines with their kind."""
    out: list[tuple[str, int, int]] = []  # and in how many strong marks the article is
    words: list[str] = []
    in_link, linked = False, 0
    open_: list[tuple[str, str]] = []  # element, and what it is: main, inner (a mark in the article), marked, strong or nothing
    held = {"main": 0, "inner": 0, "marked": 0, "strong": 0, "": 0}
    at, n = 0, len(page)

    def close() -> None:
        nonlocal linked
        if words:
            raw = "".join(words)
            if text := _SPACE.sub(" ", references.unescape(raw)).strip():
                marked = held["inner"] or not held["main"] and (held["marked"] or held["strong"])
                inside = LINKS if 2 * linked > len(raw) else ARTICLE
                out.append((text, FURNISHED if marked else inside if held["main"] else CANDIDATE, held["strong"]))
            words.clear()
        linked = 0

    def begin(name: str, what: str) -> None:
        if held["main"] and what in ("marked", "strong"):
            what = "inner"
        open_.append((name, what))
        held[what] += 1

    def end_from(k: int) -> None:
        for _, what in open_[k:]:
            held[what] -= 1
        del open_[k:]

    while at < n:
        tag = _TAG.search(page, at)
        if tag is None:
            words.append(page[at:])
            break
        if tag.start() > at:
            words.append(page[at : tag.start()])
            linked += in_link * (tag.start() - at)
        at = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        ending, attributes = bool(tag.group(1)), tag.group(3)
        if name in INLINE:
            if name == "br":
                words.append(" ")
            elif name == "a":
                in_link = not ending
            if name in VOID or name == "a":
                continue
            if not ending and (what := _mark(attributes)):
                close()
                begin(name, what)
            elif ending and open_ and open_[-1][0] == name:
                close()
                end_from(len(open_) - 1)
            continue
        close()
        empty = attributes.endswith("/") and not _UNQUOTED.search(attributes)
        if not ending:
            # elements without an end tag end here; inline elements in them too
            ends = ENDS.get(name, set()) | ({"p"} if name in ENDS_P else set())
            while ends:
                k = len(open_) - 1
                while k >= 0 and open_[k][0] in INLINE:
                    k -= 1
                if k < 0 or open_[k][0] not in ends:
                    break
                end_from(k)
        if name in SILENT and not ending:
            if empty:
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            if end and (name in RAW or not _ARTICLE.search(page, at, end.start())):
                at = end.end()
            elif end and name == "form":  # around the article
                begin(name, "strong")
            else:  # it has no end tag of its own: up to the next tag
                following = _TAG.search(page, at)
                at = following.start() if following else n
            continue
        if name in VOID:
            continue
        if not ending:
            what = "main" if name in MAIN else "" if name in ("html", "body") else _mark(attributes)
            if name in FURNITURE and not (name == "header" and held["main"]):
                what = "strong"
            if not empty:
                begin(name, what)
        else:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    end_from(k)
                    break
    close()
    fewest = min((marks for _, kind, marks in out if kind >= ARTICLE), default=0)
    return [(text, FURNISHED if kind >= ARTICLE and marks > fewest else kind) for text, kind, marks in out]


def shared_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a are in a longest common subsequence of a and b."""
    keep = [False] * len(a)
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        keep[low] = True
        low += 1
    high_a, high_b = len(a), len(b)
    while high_a > low and high_b > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
        keep[high_a] = True
    x, y = a[low:high_a], b[low:high_b]
    common = set(x) & set(y)  # the rest can't match; what is left is short
    x_at, y_at = [i for i, s in enumerate(x) if s in common], [i for i, s in enumerate(y) if s in common]
    code = {s: k for k, s in enumerate(common)}
    for i in _common_subsequence(np.array([code[x[i]] for i in x_at], np.int64), np.array([code[y[i]] for i in y_at], np.int64)):
        keep[low + x_at[i]] = True
    return keep


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of a longest common subsequence of x and each beginning of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for s in x:
        row[1:] = np.maximum.accumulate(np.where(y == s, row[:-1] + 1, row[1:]))
    return row


def _common_subsequence(x: np.ndarray, y: np.ndarray) -> list[int]:
    """The places in x of a longest common subsequence; long pairs are split in linear memory."""
    if not len(x) or not len(y):
        return []
    if len(x) > 1 and len(x) * len(y) > TABLE_CELLS:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return _common_subsequence(x[:half], y[:cut]) + [half + i for i in _common_subsequence(x[half:], y[cut:])]
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        best[i, :-1] = np.where(y == x[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(best[i, :-1][::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def nearest(path: str, before: str | None, after: str | None) -> int:
    """Which neighbour's path is nearer: -1 or 1 by the common prefix (a tie goes to the one before), 0 without any."""
    common = [next((k for k, (x, y) in enumerate(zip(path, other, strict=False)) if x != y), min(len(path), len(other))) if other is not None else -1 for other in (before, after)]
    return 0 if max(common) < 0 else -1 if common[0] >= common[1] else 1


def article_of(page: list[tuple[str, int]]) -> str | None:
    """The text of the page's article, or None if it has none."""
    found = [text for text, kind in page if kind >= ARTICLE]
    return "\n".join(found) if found else None


def candidates_of(page: list[tuple[str, int]]) -> list[str]:
    return [text for text, kind in page if kind == CANDIDATE]


def _line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, content, host, path of every page, and its lines: text (of furniture: none), kind and hash; and a hash of all but the furniture."""
    plain = F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    address = [F.lower(F.regexp_extract(plain, "^([^/?#]*)", 1)).alias("host"), F.regexp_extract(plain, "^[^/?#]*([^?#]*)", 1).alias("path")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, kinds, hashes, main = [], [], [], []
        for page in batch.column(2):
            found = lines(page.as_py() or "")
            texts.append(["" if kind == FURNISHED else text for text, kind in found])
            kinds.append([kind for _, kind in found])
            hashes.append([_line_hash(text) for text, _ in found])
            own = [h for h, kind in zip(hashes[-1], kinds[-1], strict=True) if kind != FURNISHED]
            main.append(int.from_bytes(hashlib.blake2b(repr(own).encode(), digest_size=8).digest(), "little", signed=True))
        lists = [pa.array(x, pa.list_(t)) for x, t in ((texts, pa.string()), (kinds, pa.int8()), (hashes, pa.int64()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 3, 4, 5)), *lists, pa.array(main, pa.int64())], ["page_id", "url", "content", "host", "path", "texts", "kinds", "hashes", "main"])

    source = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("content"), *address)
    return map_batches(source, work, "page_id long, url string, content long, host string, path string, texts array<string>, kinds array<tinyint>, hashes array<long>, main long")


def deletions(outlines: DataFrame) -> DataFrame:
    """page_id, content, shared: the lines (by place) that a page of parsed() shares with the nearest different one, where it shares any."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))], [*b.schema.names, "part", "at"])
            n += b.num_rows

    order = ["host", "path", "page_id", "content"]
    columns = "host string, path string, page_id long, content long, main long, hashes array<long>"
    rows = outlines.filter("host <> ''").select(*order, "main", "hashes")
    in_order = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(numbered, columns + ", part int, at long"), "outlines")
    # a row for each partition: its first and last page, and the places next to them where another one comes
    page = F.struct("host", "main")
    ends = in_order.groupBy("part").agg(F.min_by(page, "at").alias("first"), F.max_by(page, "at").alias("last"), F.max("at").alias("end"))
    others = in_order.join(ends, "part").groupBy("part").agg(F.min(F.when(page != F.col("first"), F.col("at"))).alias("first_other"), F.max(F.when(page != F.col("last"), F.col("at"))).alias("last_other"))
    at = lambda part, place: F.struct(F.col(part).alias("part"), F.col(place).alias("at"))
    w = Window.orderBy("part")
    parts = ends.join(others, "part").withColumn("begin", F.lit(0).cast("long")).select("*", at("part", "begin").alias("a"), at("part", "end").alias("z"))
    parts = parts.select("*", *(f(c).over(w).alias(f"{n}_{c}") for n, f in (("before", F.lag), ("after", F.lead)) for c in ("first", "last", "a", "z")))
    # the last page that differs from a partition's last one, and the first that differs from its first: where one page
    # fills the partition that of the partition next to it, or what that one has, and so on
    from_last = F.when(F.col("last_other").isNotNull(), at("part", "last_other")).when(F.col("before_last") != F.col("last"), F.col("before_z"))
    from_first = F.when(F.col("first_other").isNotNull(), at("part", "first_other")).when(F.col("after_first") != F.col("first"), F.col("after_a"))
    parts = parts.withColumn("low", F.last(from_last, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("high", F.first(from_first, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    before = F.when(F.col("before_last") != F.col("first"), F.col("before_z")).otherwise(F.lag("low").over(w))
    after = F.when(F.col("after_first") != F.col("last"), F.col("after_a")).otherwise(F.lead("high").over(w))
    sides = parts.select("part", before.alias("before"), after.alias("after"))
    sides = sides.select("part", F.explode(F.array(F.struct(F.col("before").alias("of"), F.lit(-1).cast("long").alias("to")), F.struct(F.col("after").alias("of"), F.lit(2**62).cast("long").alias("to")))).alias("s"))
    sent = sides.filter("s.of is not null").select(F.col("s.of.part").alias("part"), F.col("s.of.at").alias("at"), F.col("part").alias("_part"), F.col("s.to").alias("_at"))
    edge = in_order.join(F.broadcast(sent), ["part", "at"]).withColumns({"part": F.col("_part"), "at": F.col("_at")})  # two rows for each partition
    run = in_order.unionByName(edge.select(*in_order.columns))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages come by part and place; copies of each other that follow one another are finished when the next page has been seen."""
        before: tuple | None = None
        copies: list[tuple] = []  # part, host, main, at, page_id, content, path, hashes
        done: list[tuple] = []

        def finish(after: tuple | None) -> None:
            nonlocal before
            if not copies:
                return
            around = [x if x and x[:2] == copies[0][:2] else None for x in (before, after)]
            for _, _, _, at, page_id, content, path, hashes in copies:
                which = nearest(path, *(x and x[6] for x in around)) if 0 <= at < 2**61 else 0
                if which:
                    shared = shared_lines(hashes.tolist(), around[0 if which < 0 else 1][7].tolist())
                    if any(shared):
                        done.append((page_id, content, [i for i, s in enumerate(shared) if s]))
            before = copies[-1]
            copies.clear()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["page_id", "content", "shared"])
            done.clear()
            return batch

        for b in batches:
            host, path, page_id, content, main, hashes, part, at = b.columns
            for k in range(b.num_rows):
                row = (part[k].as_py(), host[k].as_py(), main[k].as_py(), at[k].as_py(), page_id[k].as_py(), content[k].as_py(), path[k].as_py(), np.asarray(hashes[k].values))
                if copies and row[:3] != copies[0][:3]:
                    finish(row)
                copies.append(row)
            if done:
                yield out()
        finish(None)
        if done:
            yield out()

    return run.repartition("part").sortWithinPartitions("part", "at").mapInArrow(compare, "page_id long, content long, shared array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html, ...)."""
    whole = kept(parsed(pages), "pages", compression="zstd")
    cuts = deletions(whole).dropDuplicates(["page_id", "content"]).alias("d")
    # prose of an article stays, shared or not: only pages with other lines of their own meet the deletions
    asks = F.exists("kinds", lambda k: k == LINKS) | ~F.exists("kinds", lambda k: k >= ARTICLE)
    same = F.col("p.page_id").eqNullSafe(F.col("d.page_id")) & (F.col("p.content") == F.col("d.content"))
    met = whole.filter(asks).alias("p").join(cuts, same, "left").select("p.page_id", "p.url", "p.texts", "p.kinds", "d.shared")
    rows = whole.filter(~asks).select("page_id", "url", "texts", "kinds", F.lit(None).cast("array<int>").alias("shared")).unionByName(met)
    own = F.when(F.exists("kinds", lambda k: k >= ARTICLE), F.lit(ARTICLE)).otherwise(F.lit(CANDIDATE))
    links = F.when(F.exists("kinds", lambda k: k == LINKS), F.lit(LINKS)).otherwise(own)
    gone = lambda k, i: (k != ARTICLE) & F.array_contains(F.coalesce("shared", F.array().cast("array<int>")), i)
    left = F.filter("texts", lambda _, i: F.get("kinds", i).isin(own, links) & ~gone(F.get("kinds", i), i))
    rows = rows.select("page_id", "url", F.array_join(left, "\n").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
