"""Main text of web pages by markup zones and a suffix array per host.

A page is cut into blocks. The word streams of a host's pages are concatenated and their suffixes
sorted; word runs that several distinct pages share are boilerplate, and a block that such runs
cover is boilerplate as a whole. This is found for the blocks of every page. A check by markup
follows: blocks inside menus, headers, footers, sidebars, notices, adverts, forms, scripts and
reader comments go though no other page has them, blocks inside an article or main element stay
though others have them too, and nothing else stays beside such an element.

Pages of one host are dealt to chunks of some ``CHUNK_PAGES`` pages by a hash, so a host of any
size is spread over many tasks. What repeats within a chunk is found by its suffixes. For hosts of
several chunks, hashes of all pages' runs are counted over the whole host and the common ones go
back to the chunks, so what is boilerplate does not depend on the chunks; hosts where the check
settles every page are left out of this count, as it cannot change their texts.

Defined cases: a null or empty html has the text ''. Repeated pages (equal word streams) count
as one page when repeats are counted, and each row gets its text. A null url is a host of its
own. A page that is cut off is read as far as it goes; an unfinished tag at its end is dropped.
Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.common import written

CHUNK_PAGES = 200
TASK_PAGES = 1_000
#: A run of this many words (a block's end counts as one) on so many pages is boilerplate.
RUN_WORDS, RUN_PAGES = 8, 3

SKIPPED, OPEN, MAIN = 0, 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"<]*"|'[^'<]*'|["'])*+)>""",
    re.S,
)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z0-9]+")

_RAW = {"script", "style", "title", "textarea", "xmp", "noembed", "noframes"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Elements and names that never hold the article, wherever they stand.
_NEVER = set("footer aside form noscript template svg math select button iframe object canvas audio video dialog menu map datalist head".split())
_NEVER_NAMES = set("comment comments commentlist disqus reply replies respond related recommended recommendations".split())
# Elements and names that do not, unless an article inside them says otherwise.
_SELDOM = {"nav", "header"}
_SELDOM_NAMES = set(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie "
    "cookies consent gdpr notice notices notification popup modal overlay sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead topbar footer bottombar share sharing social newsletter subscribe subscription signup login "
    "search toolbar widget widgets pagination pager disclaimer copyright legal".split()
)
# Inside an article they hold its heading.
_HEADS = {"header", "masthead"}
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


def _kind(tag: str, attributes: str, in_main: bool) -> int | None:
    """What an element says about the text inside it: -1 never the article, SKIPPED, MAIN, None."""
    if tag in _NEVER:
        return -1
    names: set[str] = set()
    role = ""
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                names.update(_NAME.findall(value))
            elif name == "role":
                role = value
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                return -1
    if tag in ("html", "body"):
        return None
    if names & _NEVER_NAMES:
        return -1
    if tag in ("article", "main") or role in ("main", "article"):
        return MAIN
    if role in _ROLES or names & (_SELDOM_NAMES - _HEADS if in_main else _SELDOM_NAMES) or tag == "nav" or (tag == "header" and not in_main):
        return SKIPPED
    return None


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page, in order; white space is single, entities decoded."""
    page = _UNFINISHED.sub("", page or "")
    out: list[tuple[int, str]] = []
    # Per open element its tag, and what holds inside it: the zone, and whether an article is around.
    stack: list[tuple[str, int, bool]] = []
    is_open: Counter[str] = Counter()
    pending: list[str] = []
    zone = OPEN

    def flush() -> None:
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            pending.clear()
            if text:
                out.append((zone, text))

    def drop(first: int) -> None:
        is_open.subtract(tag for tag, _, _ in stack[first:])
        del stack[first:]

    def inside(kind: int | None) -> int:
        """The zone inside a new element: what is never the article holds all the way down."""
        around = stack[-1][1] if stack else OPEN
        return around if around == -1 or kind is None else kind

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        pending.append(page[at : token.start() if token else len(page)])
        if token is None:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if tag in _INLINE:
            continue
        if tag == "br":
            pending.append(" ")
            continue
        flush()
        if token[1]:
            if is_open[tag]:
                drop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        elif tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in _VOID and not token[3].endswith("/"):
            if tag in _CLOSES_ITSELF and stack and stack[-1][0] in _CLOSES_ITSELF[tag]:
                drop(len(stack) - 1)
            if tag == "body":
                drop(0)
            kind = _kind(tag, token[3], bool(stack) and stack[-1][2])
            stack.append((tag, inside(kind), kind == MAIN or (bool(stack) and stack[-1][2])))
            is_open[tag] += 1
        zone = max(SKIPPED, stack[-1][1]) if stack else OPEN
    flush()
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in words.pieces(whole, "html"):
            blocks = [blocks_of(x) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["page_id"],
                    batch["url"],
                    batch["host"],
                    pa.array([[z for z, _ in b] for b in blocks], pa.list_(pa.int32())),
                    pa.array([[t for _, t in b] for b in blocks], pa.list_(pa.string())),
                ],
                names=["page_id", "url", "host", "zones", "blocks"],
            )


def repeated(stream: np.ndarray, page: np.ndarray, run: int = RUN_WORDS, pages: int = RUN_PAGES) -> np.ndarray:
    """True for the words inside a run of ``run`` words that ``pages`` distinct pages have.

    ``stream`` holds all pages' words one after the other, ``page`` the page of each word. The
    suffixes are sorted by prefix doubling as far as the run length needs: longer repeats are
    unions of repeats of that length.
    """
    n = len(stream)
    if n < run:
        return np.zeros(n, bool)
    rank = np.unique(stream, return_inverse=True)[1].reshape(-1).astype(np.int64) + 1
    depth, order = 1, np.argsort(rank, kind="stable")
    while depth < run:
        step = min(depth, run - depth)
        later = np.zeros(n, np.int64)
        later[: n - step] = np.where(page[step:] == page[: n - step], rank[step:], 0)
        both = rank * (n + 1) + later  # ranks are n at most
        order = np.argsort(both)
        ordered = both[order]
        fresh = np.append(1, ordered[1:] != ordered[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        depth += step
    whole = np.zeros(n, bool)
    whole[: n - run + 1] = page[run - 1 :] == page[: n - run + 1]
    # Of equal suffixes, count the distinct pages; equal ranks are neighbours in the order.
    held = order[whole[order]]
    most = int(page.max()) + 1
    ranks, count = np.unique(np.unique(rank[held] * most + page[held]) // most, return_counts=True)
    common = np.zeros(int(rank.max()) + 1, bool)
    common[ranks[count >= pages]] = True
    starts = np.flatnonzero(whole & common[rank])
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + run, -1)
    return np.cumsum(cover[:-1]) > 0


def run_hashes(stream: np.ndarray, page: np.ndarray, run: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the runs of ``run`` words that lie within one page."""
    if len(stream) < run:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    n = len(stream) - run + 1
    hashes = np.zeros(n, np.uint64)
    for i in range(run):
        hashes = words.mix(hashes + stream[i : n + i], 63)
    starts = np.flatnonzero(page[run - 1 :] == page[:n])
    return starts, hashes[starts]


def _streams(pages: list[list[str]]):
    """(words, block of each, page of each, edges of the pages, print of each page) of pages' blocks."""
    flat = pa.array([b for blocks in pages for b in blocks], pa.string())
    hashes, bounds = words.words_of(flat)
    # A block's end is a word of its own, so that short blocks in a row can be a long run.
    ends = np.arange(len(flat))
    stream = np.insert(hashes, bounds[1:], np.uint64(1))
    block = np.insert(np.repeat(ends, np.diff(bounds)), bounds[1:], ends)
    first = np.concatenate([[0], np.cumsum([len(blocks) for blocks in pages])]).astype(int)
    owner = np.searchsorted(first, ends, "right") - 1
    page = owner[block] if len(block) else np.zeros(0, int)
    edges = np.searchsorted(page, np.arange(len(pages) + 1))
    weights = words.mix(np.arange(1, len(stream) + 1, dtype=np.uint64), 61) | np.uint64(1)
    prints = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        prints.append((hi - lo, int((words.mix(stream[lo:hi]) * weights[: hi - lo]).sum(dtype=np.uint64))))
    return stream, block - first[page], page, edges, prints


def _undecided(zones: list[int]) -> bool:
    return OPEN in zones and MAIN not in zones


def shared_blocks(pages: list[list[str]], common: np.ndarray | None = None) -> list[np.ndarray]:
    """For each page of one chunk of a host, True for its blocks that boilerplate runs cover as a whole.

    ``common``: sorted hashes of runs that are boilerplate by the pages of the whole host.
    """
    stream, block, page, edges, prints = _streams(pages)
    same: dict[tuple, int] = {}
    names = np.array([same.setdefault(p, i) for i, p in enumerate(prints)], int)
    unique = names[page] == page  # the first of equal pages stands for all
    covered = np.zeros(len(stream), bool)
    covered[unique] = repeated(stream[unique], page[unique])
    if common is not None and len(common):
        starts, hashes = run_hashes(stream, page)
        for start in starts[np.isin(hashes, common)]:
            covered[start : start + RUN_WORDS] = True
    # A block's end is a word of its own and the last of the block: it need not be covered.
    ends = np.flatnonzero(np.append((block[1:] != block[:-1]) | (page[1:] != page[:-1]), True)) if len(stream) else np.zeros(0, int)
    own = np.append(0, np.cumsum(~covered))
    begins = np.append(0, ends[:-1] + 1)[: len(ends)]
    whole = own[ends] == own[begins]
    first = np.concatenate([[0], np.cumsum([len(blocks) for blocks in pages])]).astype(int)
    return [whole[first[k] : first[k + 1]] for k in names]


def _kept(zones: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The host's verdict on a page's blocks after its check by markup.

    An article stays though other pages quote it, and nothing else does beside one; furniture goes though
    it is the page's own.
    """
    article = zones == MAIN
    return article if article.any() else (zones == OPEN) & ~shared


def _texts(rows: list[tuple[list[int], list[str]]], common: np.ndarray | None = None) -> list[str]:
    """The main text of each page of one chunk of a host; a page is its zones and blocks.

    Whole blocks go or stay: a passage that others quote is no reason to cut into a block.
    """
    shared = shared_blocks([blocks for _, blocks in rows], common)
    kept = [_kept(np.array(zones, int), gone) for (zones, _), gone in zip(rows, shared, strict=True)]
    return ["\n".join(b for b, stays in zip(blocks, keep, strict=True) if stays) for (_, blocks), keep in zip(rows, kept, strict=True)]


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether markup leaves a page to its host."""
    for whole in batches:
        for batch in words.pieces(whole, "html"):
            left = [_undecided([z for z, _ in blocks_of(x)]) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(left, pa.bool_())], names=["host", "undecided"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, chunk, hash, print): the distinct runs of each page, and the print of its word stream."""
    for whole in batches:
        for batch in words.pieces(whole, "html"):
            stream, _, page, _, prints = _streams([[t for _, t in blocks_of(x)] for x in batch["html"].to_pylist()])
            starts, hashes = run_hashes(stream, page)
            owner = page[starts]
            for i in np.unique(owner):
                own = np.unique(hashes[owner == i])
                mark = words.mix(np.array([np.uint64(prints[i][1]) ^ np.uint64(prints[i][0])]), 64).view(np.int64)[0]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["host"][int(i)].as_py()] * n, pa.string()),
                        pa.array([batch["chunk"][int(i)].as_py()] * n, pa.int64()),
                        pa.array(own.view(np.int64)),
                        pa.array(np.full(n, mark)),
                    ],
                    names=["host", "chunk", "hash", "print"],
                )


def _extract(group: pa.Table, common: pa.Table) -> pa.Table:
    group = group.sort_by([("host", "ascending"), ("chunk", "ascending")])
    hosts, chunks = group["host"].to_pylist(), group["chunk"].to_pylist()
    zones, blocks = group["zones"].to_pylist(), group["blocks"].to_pylist()
    of_chunk: dict[tuple, list[int]] = {}
    for host, chunk, value in zip(common["host"].to_pylist(), common["chunk"].to_pylist(), common["hash"].to_pylist(), strict=True):
        of_chunk.setdefault((host, chunk), []).append(value)
    texts: list[str] = []
    lo = 0
    for hi in range(1, len(hosts) + 1):
        if hi == len(hosts) or (hosts[hi], chunks[hi]) != (hosts[lo], chunks[lo]):
            mine = np.array(of_chunk.get((hosts[lo], chunks[lo]), []), np.int64).view(np.uint64)
            texts += _texts(list(zip(zones[lo:hi], blocks[lo:hi], strict=True)), mine)
            lo = hi
    return pa.table({"page_id": group["page_id"], "url": group["url"], "text": pa.array(texts, pa.string())})


def _common_runs(raw: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, chunk, hash): the boilerplate runs of hosts with several chunks, for each chunk that has them."""
    wanted = sizes.where("undecided AND chunks > 1")
    pages = raw.join(wanted, raw["host"] == wanted["_host"]).select("host", F.pmod(F.xxhash64("page_id", "url"), "chunks").alias("chunk"), "html")
    runs = written(pages.mapInArrow(_runs, "host string, chunk long, hash long, print long"), "host-runs")
    # Distinct streams first, so that a run that all pages of a host have is counted on the map side.
    counted = runs.select("host", "hash", "print").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    common = written(counted.where(F.col("n") >= RUN_PAGES).select(F.col("host").alias("_host"), F.col("hash").alias("_hash")), "common-runs")
    places = runs.select("host", "chunk", "hash").distinct()
    return places.join(common, (places["host"] == common["_host"]) & (places["hash"] == common["_hash"]), "left_semi")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of ``pages``."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    raw = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    raw = raw.withColumn("host", host)
    left = raw.select("host", "html").mapInArrow(_decided, "host string, undecided boolean")
    sizes = left.groupBy(F.col("host").alias("_host")).agg(
        F.ceil(F.count(F.lit(1)) / CHUNK_PAGES).alias("chunks"), F.count(F.lit(1)).alias("n"), F.max("undecided").alias("undecided")
    )
    sizes = written(sizes, "hosts")
    bins = 1 + (sizes.agg(F.sum("n")).first()[0] or 0) // TASK_PAGES
    task = F.pmod(F.xxhash64("host", "chunk"), F.lit(bins)).alias("task")
    if sizes.where("undecided AND chunks > 1").isEmpty():
        common = raw.sparkSession.createDataFrame([], "task long, host string, chunk long, hash long")
    else:
        common = _common_runs(raw, sizes).select(task, "host", "chunk", "hash")
    schema = "page_id long, url string, host string, zones array<int>, blocks array<string>"
    parsed = raw.mapInArrow(_parse, schema)
    placed = parsed.join(sizes, parsed["host"] == sizes["_host"]).withColumn(
        "chunk", F.pmod(F.xxhash64("page_id", "url"), "chunks")
    )
    dealt = placed.select(task, "host", "chunk", "page_id", "url", "zones", "blocks")
    return dealt.groupBy("task").cogroup(common.groupBy("task")).applyInArrow(_extract, "page_id long, url string, text string")
