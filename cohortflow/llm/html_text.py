"""Operator 3: main text of pages by nearest-URL page differencing.

Method: the URL paths of one host stand in order, and each page is paired with
the nearest path before or after its own whose page differs from it, the one
that shares more leading segments. Pages are told apart by the digest of their
lines, so copies of a page under other URLs are passed over and no page is
aligned with itself. Versions of one path are paired with one another only
where the host has no other path that differs. The text lines (blocks) of both
are aligned by longest common subsequence, and lines that both share are
deleted as the host's template. What the markup itself says comes first: lines
inside an article container are the article, also where a neighbour repeats
them (quoted passages would go otherwise); lines inside menus, headers,
footers, side bars, notices, adverts, forms and comments are not, also where no
neighbour repeats them. Differencing decides on all lines that the markup
leaves open; there a line that a page's neighbour repeats goes, whatever it is.

Plan: pages are read twice. The first pass keeps hashes of the lines only.
Paths are made one each (least and greatest digest of their versions, combined
map-side) and dealt by range; what lies before and after a partition is a
table of one row per partition, so neither a host nor a run of copies that
holds a third of all pages meets in one task. Pairs meet by the digest of the
neighbour's lines. The second pass cuts the texts again and joins them with
the masks of their lines; packed, they are half as large on the way. Alignment is bit-parallel; beyond ``LCS_CELLS`` it
splits the problem in half, so its memory is bounded.

Defined results: a null html is empty, with empty text; a null URL has host
and path of their own and is paired with other such pages; a page whose host
has no page that differs keeps all its open lines; of two neighbours equally
near the one before counts; html may end anywhere; repeated rows each keep
their result; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, stage
from .url_rules import host_and_path

by_value(__name__)

#: Cells of one alignment table, in bits.
LCS_CELLS = 200_000_000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|([^<]++)|(<)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "button", "object", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements, roles and class or id words that hold no article text.
AWAY_TAGS = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu"}
AWAY_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "nav",
              "navbar", "navigation", "menu", "sidebar", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr",
              "banner", "notice", "notices", "popup", "modal", "overlay", "comment", "comments", "disqus", "replies", "share",
              "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "breadcrumb",
              "breadcrumbs", "widget", "toolbar", "pagination", "pager", "skip", "copyright", "tracking"}
ARTICLE_WORDS = {"article", "content", "post", "entry", "story", "maincontent", "articlebody", "main"}
AWAY, OPEN, ARTICLE = 0, 1, 2


def _role(tag: str, attributes: str) -> int | None:
    """What an element says about the text in it: AWAY, a container (ARTICLE, 3 or 4 by falling rank), or nothing."""
    if tag in AWAY_TAGS:
        return AWAY
    rank = {"article": ARTICLE, "main": 3}.get(tag)
    if attributes and tag not in ("html", "body"):
        for name, *value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(value).lower()
            if name == "role" and value in AWAY_ROLES:
                return AWAY
            if name == "role" and value in ("main", "article") or name == "itemprop" and value == "articlebody":
                rank = rank or 3
            elif name in ("class", "id"):
                words = set(re.findall(r"[a-z0-9]+", value))
                if words & AWAY_WORDS:
                    return AWAY
                if words & ARTICLE_WORDS and tag not in INLINE:
                    rank = rank or 4
    return rank


def lines_of(html: str | None) -> tuple[list[str], list[int]]:
    """Text lines of a page in order, and what the markup says of each: AWAY, OPEN or ARTICLE."""
    lines: list[str] = []
    roles: list[int] = []                # per line: AWAY, OPEN, or the rank of its best container
    stack: list[tuple[str, int]] = []    # open elements, with the role that holds inside
    buffer: list[str] = []
    page, at = html or "", 0

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                lines.append(text)
                roles.append(stack[-1][1] if stack else OPEN)

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        if (text := m[7] or m[8]) is not None:
            buffer.append(text)
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag or (m[2] is None and not m[0].endswith(">")):
            continue                     # comment, declaration, or a tag that the end of the page cuts
        end, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not end and not attributes.endswith("/"):
            # its content is no markup: go on after its end tag
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            if tag not in INLINE:
                flush()
            continue
        if tag == "body" and not end:
            stack.clear()                # a head that was not closed
        if tag not in INLINE:
            flush()
        if end:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if i >= 0:
                if tag in INLINE and any(t not in INLINE for t, _ in stack[i:]):
                    continue             # an inline end tag does not close blocks
                if any(r != stack[i - 1][1] if i else r != OPEN for _, r in stack[i:]):
                    flush()
                del stack[i:]
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):      # closed by the next of their kind
                while stack and (stack[-1][0] == tag or stack[-1][0] in INLINE or stack[-1][0] == "p"):
                    stack.pop()
            inside = stack[-1][1] if stack else OPEN
            role = _role(tag, attributes)
            if role == AWAY:
                flush()
            # what is away stays so; among containers the best rank holds
            new = inside if inside == AWAY or role is None else AWAY if role == AWAY else min(role, inside) if inside > OPEN else role
            stack.append((tag, new))
    flush()
    best = min((r for r in roles if r >= ARTICLE), default=None)
    return lines, [r if r == AWAY else OPEN if best is None else ARTICLE if r == best else AWAY for r in roles]


def _zeros(v: int, n: int) -> np.ndarray:
    """Zero bits among the lowest j bits, for j from 0 to n."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _rows(a: list, b: list, keep: bool) -> list[int]:
    """Bit-parallel alignment rows: zero bits below j in row i count the common subsequence of a[:i] and b[:j]."""
    full, places = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    v, out = full, [full]
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            out.append(v)
    return out if keep else [v]


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < len(a) - start and stop < len(b) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    found = [*range(start), *range(len(a) - stop, len(a))]
    both = set(a[start:len(a) - stop]) & set(b[start:len(b) - stop])
    at = [i for i in range(start, len(a) - stop) if a[i] in both]
    found += [at[i] for i in _align([a[i] for i in at], [x for x in b[start:len(b) - stop] if x in both])]
    return sorted(found)


def _align(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > LCS_CELLS:      # by halves: the best split of b for the middle of a
        mid = len(a) // 2
        head = _zeros(_rows(a[:mid], b, False)[0], len(b))
        tail = _zeros(_rows(a[:mid - 1:-1], b[::-1], False)[0], len(b))[::-1]
        j = int((head + tail).argmax())
        return _align(a[:mid], b[:j]) + [mid + i for i in _align(a[mid:], b[j:])]
    rows, i, j, out = _rows(a, b, True), len(a), len(b), []
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    here = length(i, j)
    while here:
        if length(i - 1, j) == here:
            i -= 1
        elif length(i, j - 1) == here:
            j -= 1
        else:
            i, j, here = i - 1, j - 1, here - 1
            out.append(i)
    return out[::-1]


def _beside(paths: DataFrame, back: bool) -> DataFrame:
    """``paths`` with the nearest path before (``back``) or after whose least digest differs, any host: (host, path, low) or null.

    The rows are sorted by range. Inside a partition the answer is carried along a run of equal digests; the run that
    a partition begins with takes it from the table of the partitions' ends.
    """
    order = [F.col(c) if back else F.col(c).desc() for c in ("host", "path")]
    me, name = F.struct("host", "path", "low"), "before" if back else "after"
    differs = lambda x, y: (x["host"] != y["host"]) | (x["low"] != y["low"])
    inside = Window.partitionBy("_part").orderBy(*order)
    x = paths.withColumn("_last", F.lag(me).over(inside))
    x = x.withColumn("_found", F.last(F.when(differs(F.col("_last"), me), F.col("_last")), ignorenulls=True).over(inside))
    parts = Window.orderBy(F.col("_part") if back else F.col("_part").desc())          # one row per partition
    first, last = (F.min_by, F.max_by) if back else (F.max_by, F.min_by)
    ends = x.groupBy("_part").agg(first(me, F.struct("host", "path")).alias("a"), last(me, F.struct("host", "path")).alias("z"),
                                  last("_found", F.struct("host", "path")).alias("found"))
    ends = ends.withColumn("y", F.lag("z").over(parts))
    ends = ends.withColumn("at", F.when(differs(F.col("y"), F.col("a")), F.col("y")))
    ends = ends.withColumn("out", F.last(F.coalesce("found", "at"), ignorenulls=True).over(parts))
    ends = ends.select("_part", F.coalesce("at", F.lag("out").over(parts)).alias("_carried"))
    return (x.join(F.broadcast(ends), "_part")                                         # as many rows as partitions
            .withColumn(name, F.coalesce("_found", "_carried")).drop("_last", "_found", "_carried"))


def neighbours(pages: DataFrame, digest: str = "row") -> DataFrame:
    """(row, other) of every page that has a neighbour; other is the digest of the page it is aligned with.

    ``pages`` holds row, host, path and ``digest`` (pages with the same one are copies). The neighbour's path is the
    nearest one before or after on the host whose least digest differs from that of the page's own path; of the two the
    one that shares more leading segments counts (a tie: the one before), and one that equals the page is passed over.
    Without such a path it is another version of the page's own path.
    """
    pages = pages.select("row", "host", "path", F.col(digest).alias("digest"))
    paths = pages.groupBy("host", "path").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    paths = stage(paths.repartitionByRange("host", "path").withColumn("_part", F.spark_partition_id()), "pages-order")
    beside = stage(_beside(_beside(paths, True), False).drop("_part"), "pages-beside")
    x = pages.join(beside, ["host", "path"])

    def pick(name: str) -> F.Column:
        near = F.expr(f"array_position(zip_with(split(path, '/'), split({name}.path, '/'), (x, y) -> x <=> y), false)")
        return F.when(F.expr(f"{name}.host = host AND {name}.low != digest"),
                      F.struct(near.alias("near"), F.lit(name == "before").alias("back"), F.col(f"{name}.low").alias("other")))

    version = F.when(F.col("low") != F.col("digest"), F.col("low")).when(F.col("high") != F.col("digest"), F.col("high"))
    other = F.coalesce(F.greatest(pick("before"), pick("after"))["other"], version)
    return x.select("row", other.alias("other")).where("other IS NOT NULL")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared (lines aligned with the neighbour) of every row."""
    src = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    host, path = host_and_path(F.col("url"))
    src = src.select("page_id", "url", host.alias("host"), path.alias("path"), "html")
    kind = src.schema["page_id"].dataType.simpleString()

    def known(host, path, lines):
        """Digests of a page's lines, and of host, path and lines: what a page is known by in both passes."""
        import xxhash

        digest = xxhash.xxh3_128(b"".join(xxhash.xxh3_128_digest(x) for x in lines)).digest()
        return digest, xxhash.xxh3_128_digest(f"{host}\x1f{path}\x1f".encode() + digest)

    def hashed(batches):
        import xxhash

        for b in batches:
            cut_ = [lines_of(t.as_py())[0] for t in b.column(2)]
            keys = [known(h, p, x) for h, p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), cut_)]
            lines = [[xxhash.xxh64_intdigest(y) - (1 << 63) for y in x] for x in cut_]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([d for d, _ in keys], pa.binary()), pa.array([k for _, k in keys], pa.binary()),
                                              pa.array(lines, pa.list_(pa.int64()))], ["host", "path", "digest", "row", "lines"])

    def cut(batches):
        for b in batches:
            got = [lines_of(t.as_py()) for t in b.column(4)]
            keys = [known(h, p, x)[1] for h, p, (x, _) in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), got)]
            # lines that the markup puts away keep their place, but are not moved; the others are moved packed
            packed = [zlib.compress("\n".join(t for t, k in zip(x, r) if k != AWAY).encode(), 3) for x, r in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), *b.columns[:2], pa.array(packed, pa.binary()), pa.array([r for _, r in got], pa.list_(pa.int32()))],
                ["row", "page_id", "url", "packed", "roles"])

    def kept(batches):
        for b in batches:
            out = []
            for packed, roles, shared in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                at = [i for i, r in enumerate(roles) if r != AWAY]
                gone = set(shared or ())
                lines = zlib.decompress(packed).decode().split("\n")
                out.append((" ".join(t for i, t in zip(at, lines) if roles[i] == ARTICLE or i not in gone), len(roles), len(gone)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array([t for t, _, _ in out], pa.string()), pa.array([n for _, n, _ in out], pa.int32()),
                 pa.array([n for _, _, n in out], pa.int32())], ["page_id", "url", "text", "n_lines", "n_shared"])

    def aligned(batches):
        for b in batches:
            shared = [common_lines(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared, pa.list_(pa.int32()))], ["row", "shared"])

    light = stage(src.select("host", "path", "html")
                  .mapInArrow(hashed, "host string, path string, digest binary, row binary, lines array<bigint>")
                  .dropDuplicates(["row"]), "pages-lines")
    other = light.select(F.col("digest").alias("other"), F.col("lines").alias("lines2")).dropDuplicates(["other"])
    pairs = light.select("row", "lines").join(neighbours(light, "digest"), "row").join(other, "other").select("row", "lines", "lines2")
    masks = pairs.mapInArrow(aligned, "row binary, shared array<int>")
    texts = src.mapInArrow(cut, f"row binary, page_id {kind}, url string, packed binary, roles array<int>")
    x = texts.join(masks, "row", "left").select("page_id", "url", "packed", "roles", "shared")
    out = x.mapInArrow(kept, f"page_id {kind}, url string, text string, n_lines int, n_shared int")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")
