"""Main text of web pages: page structure and the suffix arrays of their hosts.

Pages are cut into blocks. Where a page marks its article (article or main), that is the text, less
marked menus, adverts, forms, comments and the like inside it. A page without such a mark is judged
by its host: the suffixes of the host's pages outside articles, to the depth of a boilerplate run,
are merged over the whole host, and runs that occur on distinct pages are boilerplate and cut out of
their blocks. Pages are distinct by their blocks: copies of a page, under one address or several,
are one page and make nothing boilerplate.

Marked articles go through the array of their host as well. Articles are often copied, as a whole or
nearly, and a copied article is still text. So runs that the articles of more than half of the host's
pages hold are common there; an article that they cover by more than half is a copy, which stays whole
and has no vote; and a run is boilerplate (a notice in every article) if more than half of the others
hold it. Blocks of fewer tokens than a run (headings that many articles have) are text there.

A host's array is made in parts, one for the pages of a batch, by prefix doubling. Parts are merged by
the hashes of their runs. Runs longer than RUN tokens are chains of runs of RUN tokens, so that deeper
ranks would change no covered token.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, read_table

# Tokens of a run that counts as repeated.
RUN = 8
# A run is boilerplate inside articles only if so many pages of the host hold it.
LEAST_PAGES = 5
# Up to so many hosts are sent to every task, to pass over the pages of others; beyond, all pages are read.
MOST_HOSTS = 100_000
# Up to so many runs are sent to every task; beyond, pages are joined to their host's runs by a shuffle.
MOST_RUNS = 500_000
# Into so many parts the pages of one repeated run are dealt.
SALT = 16
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

SKIPPED = frozenset("script style noscript template svg math iframe object canvas head title select option button textarea".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset(("article", "main"))
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose end tag may be left out: a block that starts ends them.
CLOSED_BY_BLOCK = frozenset(("p",))
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adbox|advert|adverts|advertisement|banner|sidebar|cookie|cookies|consent|notice|popup|modal|overlay|menu|nav|"
    r"navbar|navigation|breadcrumb|breadcrumbs|footer|topbar|masthead|comment|comments|disqus|share|sharing|social|related|recommended|"
    r"promo|sponsor|sponsored|newsletter|subscribe|login|signup|search|widget|toolbar|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
# The rest of a tag: a value in quotes may hold a ">", a quote mark elsewhere means nothing.
_TAG_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+>""")
_END_TAGS = {name: re.compile(f"</{name}", re.I | re.A) for name in SKIPPED}
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _aside(name: str, attributes: str, in_main: bool) -> bool:
    if name in ASIDE or (name == "header" and not in_main):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value, key = a or b or c, key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in ROLES or key in ("class", "id") and MARKS.search(value):
            return True
    return False


def page_blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in a marked article, marked as none of the text) of every block, in page order."""
    blocks: list[tuple[str, bool, bool]] = []
    if not page:
        return blocks
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, in article, marked aside
    opened: Counter = Counter()  # their names
    endless: set[str] = set()  # skipped elements that have no end tag in the rest of the page
    main = aside = False

    def flush():
        if buffer:
            text = " ".join(_html.unescape("".join(buffer)).split())
            if text:
                blocks.append((text, main, aside))
            buffer.clear()

    at, end, find = 0, len(page), page.find
    while at < end:
        tag = find("<", at)
        if tag < 0:
            buffer.append(page[at:])
            break
        if tag > at:
            buffer.append(page[at:tag])
        if page.startswith("<!--", tag):
            close = find("-->", tag + 4)
            at = end if close < 0 else close + 3
            continue
        second = page[tag + 1 : tag + 2]
        if second in ("!", "?"):
            close = find(">", tag)
            at = end if close < 0 else close + 1
            continue
        match = _NAME.match(page, tag + 1)
        if not match:
            buffer.append("<")
            at = tag + 1
            continue
        rest = _TAG_END.match(page, match.end())
        close = rest.end() - 1 if rest else end
        name, attributes = match.group(1).lower(), page[match.end() : close]
        at = close + 1
        closing = second == "/"
        if name in SKIPPED and not closing:
            if attributes.endswith("/"):
                continue
            stop = None if name in endless else _END_TAGS[name].search(page, at)
            if not stop:
                endless.add(name)
                if name != "head":
                    at = end
                continue
            close = find(">", stop.end())
            at = end if close < 0 else close + 1
            continue
        if name in BREAKS:
            flush()
            if not closing:
                while stack and stack[-1][0] in CLOSED_BY_BLOCK:
                    opened[stack.pop()[0]] -= 1
                main, aside = stack[-1][1:] if stack else (False, False)
        elif name == "br":
            buffer.append(" ")
        if name in VOID or attributes.endswith("/"):
            continue
        if closing:
            if opened[name]:
                flush()
                last = None
                while last != name:
                    last = stack.pop()[0]
                    opened[last] -= 1
                main, aside = stack[-1][1:] if stack else (False, False)
        else:
            marked = _aside(name, attributes, main)
            if marked or name in BREAKS:
                if marked and not aside:
                    flush()
                main, aside = main or name in MAIN, aside or marked
                stack.append((name, main, aside))
                opened[name] += 1
    flush()
    return blocks


class HostSuffixes:
    """The suffix arrays of the hosts of a batch of pages, to the depth of a run.

    Suffixes end with their blocks. rank numbers them by host and their first RUN tokens, so that
    those of equal rank share a run; order lists the suffixes that begin a run by rank, then page: one
    host's array after the other. With short, blocks of fewer tokens are a run of their own.
    """

    def __init__(self, hosts: np.ndarray, blocks: pa.ListArray, run: int = RUN, short: bool = True):
        self.run, self.blocks = run, blocks.flatten()
        self.block_row = np.repeat(np.arange(len(blocks)), _lengths(blocks))
        words = pc.split_pattern(self.blocks, " ")
        self.size = _lengths(words)
        coded = words.flatten().dictionary_encode()
        self.codes, self.dictionary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        self.hosts, n = hosts, len(self.codes)
        block = np.repeat(np.arange(len(self.size)), self.size)
        self.left = np.cumsum(self.size)[block] - np.arange(n)
        self.row = self.block_row[block]
        self.starts = np.flatnonzero((self.left >= run) | ((self.left == self.size[block]) & short))

    def sort(self) -> None:
        n, place = len(self.codes), np.empty(len(self.dictionary), np.int64)
        place[pc.sort_indices(self.dictionary).to_numpy()] = np.arange(len(place))
        host = np.unique(self.hosts, return_inverse=True)[1].astype(np.int64)
        rank, depth = _ranks(host[self.row] * len(place) + place[self.codes]), 1
        while depth < self.run:
            step = min(depth, self.run - depth)
            after = np.zeros(n, np.int64)
            after[: max(n - step, 0)] = rank[step:]
            after[self.left <= step] = 0
            rank, depth = _ranks(rank * (n + 1) + after), depth + step
        self.rank = rank
        self.order = self.starts[np.lexsort((self.row[self.starts], rank[self.starts]))]

    def pages_of_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(a suffix, number of its run) for every page of every run, in the order of the array."""
        rank, row = self.rank[self.order], self.row[self.order]
        new_run = np.append(True, rank[1:] != rank[:-1])[: len(rank)]
        new_page = new_run | np.append(True, row[1:] != row[:-1])[: len(rank)]
        return self.order[new_page], (np.cumsum(new_run) - 1)[new_page]

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs that begin there; equal runs have equal ones in all batches."""
        width = np.minimum(self.left[starts], self.run)
        used = np.zeros(len(self.dictionary), bool)
        for k in range(self.run):
            used[self.codes[starts[width > k] + k]] = True
        each = np.zeros(len(used), np.uint64)
        each[used] = np.array([_token_hash(t) for t in self.dictionary.filter(pa.array(used)).to_pylist()], np.uint64)
        out = width.astype(np.uint64)
        for k in range(self.run):
            more = width > k
            out[more] = out[more] * _STEP + each[self.codes[starts[more] + k]]
        out = (out ^ (out >> np.uint64(31))) * _MIX
        return (out ^ (out >> np.uint64(29))).view(np.int64)

    @cached_property
    def all_hashes(self) -> np.ndarray:
        return self.hashes(self.starts)

    def cover(self, hits: pa.ListArray) -> np.ndarray:
        """Which tokens are in a run whose hash is among the hits of their page."""
        cover = np.zeros(len(self.codes) + 1, np.int64)
        salt = lambda row: row.astype(np.uint64) * _STEP
        wanted = hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        wanted = wanted + salt(np.repeat(np.arange(len(hits)), _lengths(hits)))
        found = self.starts[np.isin(self.all_hashes.view(np.uint64) + salt(self.row[self.starts]), wanted)]
        np.add.at(cover, found, 1)
        np.add.at(cover, found + np.minimum(self.left[found], self.run), -1)
        return np.cumsum(cover)[:-1] > 0

    def texts(self, covered: np.ndarray, dropped: np.ndarray) -> list[str]:
        """Text of every page: its blocks but the dropped ones, without the covered tokens."""
        lines: list[list[str]] = [[] for _ in range(len(self.hosts))]
        ends = np.cumsum(self.size)
        any_covered = np.add.reduceat(covered, ends - self.size) > 0 if len(ends) else ends
        for b in np.flatnonzero(~dropped):
            line = self.blocks[b].as_py()
            if any_covered[b]:
                line = " ".join(t for t, c in zip(line.split(" "), covered[ends[b] - self.size[b] : ends[b]], strict=True) if not c)
            if line:
                lines[self.block_row[b]].append(line)
        return ["\n".join(x) for x in lines]


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys, from 1; 0 is the end of a block."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1


def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def extract_main_text(
    df: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id", structure: bool = True
) -> DataFrame:
    """id, url, text (blocks joined by a line feed, empty if none) and n_chars of every row.

    Null html counts as empty; null urls and urls without a host are one host. Repeated rows are
    extracted each; further columns aren't read; an empty table gives an empty table. Long pages and
    deeply nested ones take time in proportion to their length. With structure=False marks count for
    nothing and the host's suffix array alone decides on every block of every page.
    """
    bound_batches(df.sparkSession)
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract(F.col(url_col), _HOST, 1)), F.lit("")))
    rows = df.select(
        F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), host.alias("__host"),
        F.col(html_col).cast("string").alias("__html"),
    )
    kind = rows.schema["__id"].dataType.simpleString()

    def parse(batches):
        for batch in batches:
            articles, contents, left, marks, opened = [], [], [], [], []
            for page in batch.column(3).to_pylist():
                blocks = page_blocks(page)
                if not structure:
                    blocks = [(t, False, False) for t, _, _ in blocks]
                opened.append(_open(blocks))
                articles.append([t for t, m, a in blocks if m and not a])
                contents.append(_content(blocks))
                left.append([t for t, m, _ in blocks if not m])
                marks.append([a for _, m, a in blocks if not m])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in range(3)), pa.array(contents, pa.int64()), pa.array(opened, pa.bool_()),
                    pa.array(articles, pa.list_(pa.string())), pa.array(left, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.bool_())),
                ],
                ["__id", "__url", "__host", "__page", "open", "article", "blocks", "aside"],
            )

    # Pages are parsed once; all that follows reads the parsed blocks.
    parsed = checkpointed(
        rows.mapInArrow(
            parse,
            f"__id {kind}, __url string, __host long, __page long, open boolean, article array<string>, blocks array<string>, aside array<boolean>",
        )
    )
    out = _articles(parsed.where("not open").select("__id", "__url", "__host", "article"), kind)
    # Only hosts with a page without a marked article are judged; where they are few, others aren't read again.
    some, few = _few(parsed.where("open").select("__host").distinct())
    if some:
        of_hosts = parsed if few is None else parsed.join(few, "__host", "left_semi")
        out = out.union(_judged(of_hosts.select(*parsed.columns), kind))
    return out.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))


def _open(blocks: list[tuple[str, bool, bool]]) -> bool:
    """Whether the page has text, but no marked article; one marked aside (a comment, an advert) is none."""
    return bool(blocks) and not any(m and not a for _, m, a in blocks)


def _content(blocks: list[tuple[str, bool, bool]]) -> int:
    """The page's number: a hash of the texts of its blocks."""
    text = "\n".join(t for t, _, _ in blocks).encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _few(hosts: DataFrame, most: int = MOST_HOSTS) -> tuple[bool, DataFrame | None]:
    """Whether there are any, and the rows to be sent to every task, if they are few."""
    rows = hosts.limit(most + 1).collect()
    return bool(rows), F.broadcast(hosts.sparkSession.createDataFrame(rows, hosts.schema)) if len(rows) <= most else None


def _articles(pages: DataFrame, kind: str) -> DataFrame:
    """Texts of the pages with a marked article, by the runs that most articles of their host hold.

    A part of the array gives the runs that more than a quarter of its pages hold, with what they
    exceed that quarter by. A run of more than half of the host's pages exceeds it by more than a
    quarter of them in sum over these parts, since in the others it has a quarter at most; so no such
    run is missed, and few others are left to be counted over all pages.
    """
    whole = pages.select("__id", "__url", F.array_join("article", "\n").alias("text"))
    sizes = pages.where("size(article) > 0").groupBy("__host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    some, few = _few(sizes)
    if not some:
        return whole
    of_hosts = pages.where("size(article) > 0").select("__host", "article")
    of_hosts = of_hosts if few is None else of_hosts.join(few, "__host", "left_semi")
    sizes = sizes if few is None else few

    def part(batches):
        for batch in batches:
            hosts = batch.column(0).to_numpy()
            suffixes = HostSuffixes(hosts, batch.column(1), short=False)
            suffixes.sort()
            starts, run = suffixes.pages_of_runs()
            first = starts[np.append(True, run[1:] != run[:-1])[: len(run)]]
            held, of_host = np.bincount(run), hosts[suffixes.row[first]]
            known, pages_of = np.unique(hosts[np.unique(suffixes.row)], return_counts=True)
            excess = 4 * held - pages_of[np.searchsorted(known, of_host)] if len(first) else held
            kept = excess > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (of_host[kept], suffixes.hashes(first[kept]), excess[kept])], ["__host", "__run", "excess"]
            )

    def read(batch):
        suffixes = HostSuffixes(batch.column(0).to_numpy(), batch.column(1), short=False)
        covered = suffixes.cover(batch.column(2))
        held, size = (np.bincount(x, minlength=len(batch.column(0))) for x in (suffixes.row[covered], suffixes.row))
        return suffixes, covered, 2 * held > size

    def votes(batches, of_copies):
        # A null run for every page that votes, and the wanted runs that it holds.
        for batch in batches:
            suffixes, _, copies = read(batch)
            hashes, rows = suffixes.all_hashes, suffixes.row[suffixes.starts]
            cuts = np.searchsorted(rows, np.arange(len(copies) + 1))
            hosts, runs = [], []
            for i, wanted in enumerate(batch.column(2)):
                if of_copies or not copies[i]:
                    found = np.intersect1d(hashes[cuts[i] : cuts[i + 1]], wanted.values.to_numpy())
                    runs += [None, *found.tolist()]
                    hosts += [int(suffixes.hosts[i])] * (1 + len(found))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(runs, pa.int64())], ["__host", "__run"])

    def most(runs, of_copies):
        of_runs = of_hosts.join(runs, "__host").select("__host", "article", "hits")
        counted = of_runs.mapInArrow(lambda batches: votes(batches, of_copies), "__host long, __run long").groupBy("__host", "__run").count()
        counted = checkpointed(counted)
        voters = counted.where("__run is null").select("__host", F.col("count").alias("voters"))
        held = counted.where(F.col("__run").isNotNull() & (F.col("count") >= LEAST_PAGES)).join(voters, "__host")
        return _of_hosts(checkpointed(held.where("2 * count > voters").select("__host", "__run")))

    def cut(batches):
        for batch in batches:
            suffixes, covered, copies = read(batch.select(["__host", "article", "common"]))
            covered = suffixes.cover(batch.column(5)) & ~copies[suffixes.row]
            texts = suffixes.texts(covered, np.zeros(len(suffixes.size), bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["__id", "__url", "text"])

    parts = of_hosts.mapInArrow(part, "__host long, __run long, excess long")
    likely = parts.groupBy("__host", "__run").agg(F.sum("excess").alias("excess")).join(sizes, "__host").where("excess > pages")
    some, runs = _of_hosts(checkpointed(likely.select("__host", "__run")))
    some, common = most(runs, True) if some else (some, runs)
    some, runs = most(common, False) if some else (some, runs)
    if not some:
        return whole
    judged = pages.join(common.withColumnRenamed("hits", "common"), "__host", "left").join(runs, "__host", "left")
    kept = judged.where("hits is null").select("__id", "__url", F.array_join("article", "\n").alias("text"))
    found = judged.where("hits is not null").select("__id", "__url", "__host", "article", "common", "hits")
    return kept.union(found.mapInArrow(cut, f"__id {kind}, __url string, text string"))


def _of_hosts(runs: DataFrame) -> tuple[bool, DataFrame]:
    """Whether there are any runs, and those of every host as a list, to be sent to every task if they are few."""
    n = runs.count()
    lists = runs.groupBy("__host").agg(F.collect_list("__run").alias("hits"))
    return n > 0, F.broadcast(checkpointed(lists)) if n <= MOST_RUNS else lists


def _judged(parsed: DataFrame, kind: str) -> DataFrame:
    """Texts of the pages without a marked article, by the runs that other pages of their host hold too.

    The parts of a host's array are merged by (host, run) with partial sums, so that a host of any
    size is spread over all tasks: a run is repeated if its least page isn't its greatest. Pages are
    numbered by a hash of their blocks, so that copies are one page. Runs that very many pages hold
    are salted where they are joined back.
    """

    def runs(batches):
        for batch in batches:
            hosts, pages, opened = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            suffixes = HostSuffixes(hosts, batch.column(3))
            suffixes.sort()
            starts, run = suffixes.pages_of_runs()
            first = starts[np.append(True, run[1:] != run[:-1])[: len(run)]]
            row = suffixes.row[starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (hosts[row], suffixes.hashes(first)[run], pages[row], opened[row])], ["__host", "__run", "__page", "__open"]
            )

    def cut(batches):
        for batch in batches:
            suffixes = HostSuffixes(np.zeros(len(batch.column(0)), np.int64), batch.column(2))
            aside = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(bool)
            texts = suffixes.texts(suffixes.cover(batch.column(4)), aside)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["__id", "__url", "text"])

    found = parsed.select("__host", "__page", "open", "blocks").mapInArrow(runs, "__host long, __run long, __page long, __open boolean")
    counted = found.groupBy("__host", "__run").agg(F.min("__page").alias("lo"), F.max("__page").alias("hi"), F.max("__open").alias("of_open"))
    repeated = counted.where("lo <> hi and of_open").select("__host", "__run", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    salted = found.where("__open").select("__host", "__run", "__page", F.pmod("__page", F.lit(SALT)).cast("int").alias("__salt"))
    hits = salted.join(repeated, ["__host", "__run", "__salt"]).groupBy("__host", "__page").agg(F.collect_set("__run").alias("hits"))
    return (
        parsed.where("open").join(hits, ["__host", "__page"], "left")
        .select("__id", "__url", "blocks", "aside", "hits")
        .mapInArrow(cut, f"__id {kind}, __url string, text string")
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))
