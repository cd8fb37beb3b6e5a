"""Main text of web pages, with page differencing inside each host."""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import bound_batches, checkpoint, release
from skein.llm.url_filter import host_path

NAME = re.compile(r"/?[a-zA-Z][-a-zA-Z0-9:]*")
QUOTED = re.compile(r">|=\s*[\"']")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea iframe noembed noframes title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav header footer aside form menu dialog button select label fieldset head search object canvas audio video svg math template noscript".split())
CONTENT = frozenset("article main".split())
#: Words of a class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar side aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended comment comments commentlist disqus reply replies respond discussion toolbar pagination pager copyright masthead skip".split()
)
#: Of these, the ones that mark a name they begin (``ad-slot``); any of MARKS marks a name that it ends (``site-footer``), unless
#: the name begins with one of OTHER (``has-comments`` says something about the article, not that it is a comment).
FIRST = frozenset("ad ads advert nav cookie cookies comment comments share social related newsletter sidebar footer breadcrumb sponsor sponsored promo menu banner".split())
OTHER = frozenset("has with no without is not hide show".split())
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: What a tag ends when it is the innermost open block.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Parts in which the joins with a host's copies are salted.
SALTS = 8
#: A line inside article or main is the host's if differencing takes it from over half of so many different pages at least.
LEAST_PAGES = 4
#: Pages with lines to take away, up to which they are broadcast.
BROADCAST_ROWS = 50_000


@lru_cache(65536)
def marked(attributes: str, content: bool = False) -> bool:
    """Whether class, id or role mark the element; article and main are marked by whole names only."""
    for value in ATTRIBUTE.findall(attributes):
        for name in value.lower().strip("\"'").split():
            pieces = re.split(r"[^a-z0-9]+", name.strip("-_"))
            if name in MARKS or not content and pieces[0] not in OTHER and (pieces[-1] in MARKS or pieces[0] in FIRST):
                return True
    return False


def tags(page: str):
    """(start, end, closing, name, attributes) of every tag, (start, end, None, None, text) of comments and the like.

    One pass: where a tag's quotes never close, tags end at the first > from there on, whatever is quoted.
    """
    at, size, quotes = page.find("<"), len(page), True
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
            yield at, end, None, None, ""
        elif page.startswith("<![CDATA[", at) and (end := page.find("]]>", at)) >= 0:
            yield at, end + 3, None, None, page[at + 9 : end]
            end += 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 or size
            yield at, end, None, None, ""
        elif m := NAME.match(page, at + 1):
            end = m.end()
            while quotes:
                q = QUOTED.search(page, end)
                if q and q[0] == ">":
                    end = q.end()
                    break
                close = page.find(q[0][-1], q.end()) if q else -1
                if close < 0:
                    quotes = False
                else:
                    end = close + 1
            if not quotes:
                end = page.find(">", m.end()) + 1
                if not end:
                    return  # the page ends inside a tag
            closing = m[0][0] == "/"
            name = m[0][closing:].lower()
            jump = yield at, end, closing, name, page[m.end() : end - 1]
            if jump:
                end = jump
                yield at, end, None, None, ""
        else:
            end = at + 1
        at = page.find("<", end)


def lines(page: str) -> list[tuple[str, bool]]:
    """(line, sure): the page's blocks of text outside menus and the like; sure if inside article or main."""
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, hidden, sure
    blocks: list[int] = []  # places of the stack's blocks
    opened: Counter = Counter()
    hidden = sure = False
    at = 0

    def flush():
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((line, sure))
            text.clear()

    def leave(place: int):
        for name, _, _ in stack[place:]:
            opened[name] -= 1
        del stack[place:]
        while blocks and blocks[-1] >= place:
            blocks.pop()
        return stack[-1][1:] if stack else (False, False)

    found = tags(page)
    for start, end, closing, name, attributes in found:
        if not hidden and start > at:
            text.append(page[at:start])
        at = end
        if name is None:
            if attributes and not hidden:
                text.append(html.escape(attributes))
        elif name == "br":
            text.append(" ")
        elif closing:
            if opened[name]:
                if name in BLOCKS:
                    flush()
                place = len(stack) - 1
                while stack[place][0] != name:
                    place -= 1
                hidden, sure = leave(place)
            elif name == "p":
                flush()
        elif name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, end)
            at = stop.end() if stop else len(page)
            found.send(at)
            if name in BLOCKS:
                flush()
        else:
            if name in BLOCKS:
                flush()
            if name in VOID or attributes.endswith("/"):
                continue
            ends = ENDS.get(name, ("p",) if name in BLOCKS else ())
            if ends and blocks and stack[blocks[-1]][0] in ends:  # a new paragraph ends an open one, with what is open in it
                hidden, sure = leave(blocks[-1])
            within = name not in ("html", "body") and (name in NEVER or bool(attributes) and marked(attributes, name in CONTENT))
            hidden, sure = hidden or within, sure or name in CONTENT
            if name in BLOCKS or name in NEVER:
                blocks.append(len(stack))
            stack.append((name, hidden, sure))
            opened[name] += 1
    if not hidden and at < len(page):
        rest = page[at:]
        text.append(rest[: m.start()] if (m := re.search(r"<[/!?a-zA-Z]", rest)) else rest)
    flush()
    return out


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of a longest common subsequence of a and each beginning of b."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return row


def shared(a: list, b: list) -> set[int]:
    """Positions in a of a longest common subsequence of a and b: exact, by halves, in space of a line each."""
    number = {x: i for i, x in enumerate(dict.fromkeys(b))}
    mine = [i for i, x in enumerate(a) if x in number]
    known = {a[i] for i in mine}
    x = np.array([number[a[i]] for i in mine], np.int64)
    y = np.array([number[v] for v in b if v in known], np.int64)
    out, todo = set(), [(0, len(x), 0, len(y))]
    while todo:
        p, q, r, s = todo.pop()
        while p < q and r < s and x[p] == y[r]:
            out.add(mine[p])
            p, r = p + 1, r + 1
        while p < q and r < s and x[q - 1] == y[s - 1]:
            out.add(mine[q - 1])
            q, s = q - 1, s - 1
        if p == q or r == s:
            continue
        if q - p == 1:
            if (y[r:s] == x[p]).any():
                out.add(mine[p])
            continue
        half = (p + q) // 2
        cut = r + int((lengths(x[p:half], y[r:s]) + lengths(x[half:q][::-1], y[r:s][::-1])[::-1]).argmax())
        todo += [(p, half, r, cut), (half, q, cut, s)]
    return out


def common_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Every page is compared with the page of the nearest URL path of its host, among pages of its layout: those
    that hold article or main, and those that hold neither. Their lines outside menus and the like are aligned
    by a longest common subsequence, and the shared ones go. Of pages that hold article or main only the lines
    in these count, and as two articles may share a line of their own (a licence, a quotation), a check follows:
    a shared line goes if it is shared on over half of the host's different pages of that layout, LEAST_PAGES of
    them at least; else it stays. Pages of equal lines are copies, that tell nothing about each other: they are
    one in the order of paths, at the first of their paths, and go alike. The nearest is the neighbour in that
    order whose path agrees with the page's for longer, the one before if equal. A host of any size spreads over
    tasks: neighbours are found within ranges of paths, then among the ranges' ends, so the result doesn't
    depend on the partitions.

    Null or empty html gives empty text. Null urls count as host and path "". Repeated rows each give a row.
    Character references are decoded, white space in a block is one space, blocks are joined by a line break
    in page order. The page may end inside a tag, which then goes. Other columns are left out.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def parse(batches):
        for batch in batches:
            inside, kept = [], []
            for page in batch.column(2):
                found = lines(page.as_py() or "")
                keep = [x for x, s in found if s]
                inside.append(bool(keep))
                kept.append(keep or [x for x, _ in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(inside, pa.bool_()), pa.array(kept, pa.list_(pa.string()))], names=["page_id", "url", "inside", "lines"])
            del batch
        release()

    def differ(batches):
        for batch in batches:
            path, mine, p_path, p, n_path, q = (batch.column(i).to_pylist() for i in range(4, 10))
            gone = []
            for own, x, before, prev, after, next_ in zip(path, mine, p_path, p, n_path, q):
                other = next_ if prev is None or next_ is not None and common_start(own, after) > common_start(own, before) else prev
                gone.append(sorted(shared(x, other)) if other else [])
            lost = [[x[i] for i in own] for x, own in zip(mine, gone)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(gone, pa.list_(pa.int32())), pa.array(lost, pa.list_(pa.int64()))], names=["host", "inside", "a", "b", "gone", "lost"])

    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(parse, "page_id long, url string, inside boolean, lines array<string>")
    host, path = host_path(F.col("url"))
    hashes = F.transform("lines", lambda x: F.xxhash64(x))
    parsed = parsed.select("page_id", "url", "inside", "lines", host.alias("host"), path.alias("path"), hashes.alias("hashes"))
    parsed = parsed.withColumns({"a": F.xxhash64("hashes"), "b": F.xxhash64(F.lit(1), "hashes")})
    # one row for each different page of a host and layout, in the order of paths
    page, order = ["host", "inside", "a", "b"], ["path", "a", "b"]
    each = parsed.where(F.size("lines") > 0).groupBy(*page).agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"))
    each = checkpoint(each.repartitionByRange(n, "host", "inside", *order).withColumn("part", F.spark_partition_id()))  # ranges are drawn anew whenever computed
    within, ends = Window.partitionBy("host", "inside", "part").orderBy(*order), Window.partitionBy("host", "inside").orderBy("part", *order)
    pair = F.struct("path", "hashes")
    placed = each.withColumns({"prev": F.lag(pair).over(within), "next": F.lead(pair).over(within)})
    # a part's first row has the last one of the part before, and the other way round
    whole = placed.where(F.col("prev").isNotNull() & F.col("next").isNotNull())
    edge = placed.where(F.col("prev").isNull() | F.col("next").isNull())
    edge = edge.withColumns({"p2": F.lag(pair).over(ends), "n2": F.lead(pair).over(ends)})
    edge = edge.withColumns({"prev": F.coalesce("prev", "p2"), "next": F.coalesce("next", "n2")}).drop("p2", "n2")
    paired = whole.unionByName(edge).select(*page, "path", "hashes", "prev.path", "prev.hashes", "next.path", "next.hashes").toDF(*page, "path", "mine", "pp", "ph", "np", "nh")
    gone = checkpoint(paired.mapInArrow(differ, "host string, inside boolean, a long, b long, gone array<int>, lost array<long>").where(F.size("gone") > 0))
    # inside article and main: the lines that go from over half of the host's pages
    times = gone.where("inside").select("host", F.explode(F.array_distinct("lost")).alias("h")).groupBy("host", "h").agg(F.count("*").alias("c"))
    many = each.where("inside").groupBy("host").agg(F.count("*").alias("n"))
    hosts = times.join(many, "host").where((F.col("n") >= LEAST_PAGES) & (2 * F.col("c") > F.col("n"))).groupBy("host").agg(F.collect_list("h").alias("own"))  # fewer than twice a page's lines
    # pages of a host and copies of a page may be many: both sides of the joins are salted
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    salted = gone.where("inside").withColumn("salt", F.pmod("a", F.lit(SALTS)).cast("int")).join(hosts.select("*", salts), ["host", "salt"])
    of_host = F.filter(F.arrays_zip("gone", "lost"), lambda x: F.array_contains(F.col("own"), x["lost"]))
    checked = salted.select(*page, F.transform(of_host, lambda x: x["gone"]).alias("gone")).where(F.size("gone") > 0)
    gone = checkpoint(gone.where("not inside").select(*page, "gone").unionByName(checked))
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = parsed.join(F.broadcast(gone), page, "left")
    else:
        own = parsed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = own.join(gone.select("*", salts), [*page, "salt"], "left")
    kept = F.filter(F.col("lines"), lambda x, i: ~F.array_contains(F.col("gone"), i))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n")
    return joined.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
