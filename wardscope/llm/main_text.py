"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree.  An element node knows the different ways its content
is laid out (style nodes: the sequence of its children, runs of equal children as one), and each
child stands under the style it occurs in.  Two entropies, with the number m of pages that show an
element as the base of the logarithm, give importances between 0 and 1:

* presentation: how evenly an element's styles are spread over the pages; a fixed layout gets 0;
* content: an element's own blocks of text, link targets and image sources are the features of a leaf
  below it, whose importance is one minus their mean entropy over the pages; what every page repeats gets 0, what a page has alone gets 1.

An inner element's composite importance is (1 - D^l) of its presentation and D^l of its children's,
weighted by the share of their style (l styles, D the damping).  A branch in which every element is
below the threshold is noise and is removed from each page.  An element that fewer than
``least_pages`` pages show is not judged.

Names are prior knowledge beside the tree: elements named as menus, footers, adverts, forms,
comments and the like go; where a page names its article, other parts go too, and headings and
paragraphs right below the article stay, as copies of an article are no template.  ``names=False``
leaves the tree alone to decide.

The tree is a table of nodes keyed by a digest of host and path, so a host with a third of all pages
is summed like any other.  Importances roll up without a loop: every node adds its own part, times
the weights along its path, to each of its ancestors (at most ``DEEPEST`` + 2).

Defined results: a null or empty html has an empty text; pages without a host (null url) are not
merged with others and only names decide; rows that repeat an id or url are each a page; an empty
table gives no rows; other columns only come along if they are in ``keep``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscope.llm.common import arrow_types, cut_lineage, ship_package
from wardscope.llm.page_dom import DEEPEST, PROSE, Page

#: Pages and bytes of html of a chunk; a longer page is a chunk of its own.
CHUNK_PAGES, CHUNK_BYTES = 1000, 4_000_000
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
DAMPING = 0.9
THRESHOLD = 0.4
LEAST_PAGES = 4


def host_of(url: str | None) -> str:
    m = HOST.match(url.strip()) if url else None
    return m.group(1).lower().rstrip(".") if m else ""


def digest(*parts: object) -> int:
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


class PlacedPage:
    """A page's elements as nodes of its host's tree."""

    def __init__(self, page: Page, host: str):
        self.page = page
        children: list[list[tuple[str, int]]] = [[] for _ in page.tags]  # name and element, -1: own content
        own = {e for e, _ in page.blocks} | {e for e, _ in page.links}
        for e in range(1, len(page.tags)):
            children[page.parents[e]].append((page.names[e], e))
        for e in own:
            children[e].append(("#own", -1))
        self.node = [0] * len(page.tags)
        self.leaf = [0] * len(page.tags)  # the node that holds an element's own content
        self.styles: Counter = Counter()
        #: node: name, path of nodes from the root, key of the parent's style, number of children in that style
        self.nodes: dict[int, tuple[str, list[int], int, int]] = {}
        root = digest(host)
        self.node[0] = self.leaf[0] = root
        self.nodes[root] = ("html", [root], 0, 1)
        for e in range(len(page.tags)):  # parents come before their children
            if not children[e]:
                continue
            here = self.node[e]
            path = self.nodes[here][1]
            runs = [name for k, (name, _) in enumerate(children[e]) if k == 0 or children[e][k - 1][0] != name]
            style, run = digest(here, *runs), -1
            self.styles[here, style] += 1
            for k, (name, child) in enumerate(children[e]):
                if k == 0 or children[e][k - 1][0] != name:
                    run += 1
                    node = digest(style, run, name)
                    self.nodes.setdefault(node, (name, [*path, node], style, len(runs)))
                if child < 0:
                    self.leaf[e] = node
                else:
                    self.node[child] = self.leaf[child] = node
        self.features = Counter((self.leaf[e], digest("text", t)) for e, t in page.blocks)
        self.features.update((self.leaf[e], digest("link", t)) for e, t in page.links)

    def candidates(self, names: bool) -> Iterator[tuple[str, int, bool]]:
        """Blocks that names leave in, each with its leaf node and whether the tree may remove it."""
        page = self.page
        dropped, inside = [False] * len(page.tags), [False] * len(page.tags)
        holds = [False] * len(page.tags)  # an element around a named article is no noise by its own name
        for e in range(len(page.tags) - 1, 0, -1):
            if page.main[e] or holds[e]:
                holds[page.parents[e]] = True
        articles = {e for e in range(len(page.tags)) if page.tags[e] == "article"} or {e for e, m in enumerate(page.main) if m}
        for e in range(1, len(page.tags)):
            up = page.parents[e]
            dropped[e] = dropped[up] or page.noise[e] and not holds[e] and not page.main[e] or page.noise[e] and inside[up]
            inside[e] = inside[up] or e in articles
        scoped = any(inside[e] and not dropped[e] for e, _ in page.blocks)
        for e, text in page.blocks:
            if not names:
                yield text, self.leaf[e], True
            elif not dropped[e] and (inside[e] or not scoped):
                up = page.parents[e]
                kept = scoped and (e in articles or page.tags[e] in PROSE and (up in articles or page.tags[up] == "header" and page.parents[up] in articles))
                yield text, self.leaf[e], not kept


STATS = (
    "chunk string, payload binary, node array<long>, host array<string>, name array<string>, path array<array<long>>, style_in array<long>, width array<long>, pages array<long>, "
    "s_node array<long>, s_style array<long>, s_count array<long>, f_node array<long>, f_key array<long>, f_count array<long>, f_log array<double>"
)


def _chunks(df: DataFrame, keep: list[str], url: str, source: str, names: bool) -> DataFrame:
    picked = df.select(*[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)], F.col(url).cast("string").alias("_url"), F.col(source).alias("_html"))
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        types = arrow_types(", ".join(c for c in STATS.split(", ") if not c.startswith("path ")))
        types = {c.split()[0]: types.get(c.split()[0], pa.list_(pa.list_(pa.int64()))) for c in STATS.split(", ")}
        for whole in batches:
            for batch in _slices(whole, kept + 1):
                made = _chunk(batch, kept, names)
                made["chunk"] = f"{part}-{number}"
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([made[c]], t) for c, t in types.items()], names=list(types))

    return cut_lineage(picked.mapInArrow(run, STATS))


def _slices(batch: pa.RecordBatch, source: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(source)), 0).to_pylist()
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and (held + size > CHUNK_BYTES or k - start >= CHUNK_PAGES):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def _chunk(batch: pa.RecordBatch, kept: int, names: bool) -> dict:
    """Summed statistics of a chunk's pages, and the pages' remaining blocks as a compressed table."""
    nodes, hosts, pages, styles = {}, {}, Counter(), Counter()
    features: dict[tuple[int, int], list] = {}
    texts, leaves, judged = [], [], []
    for url, source in zip(batch.column(kept).to_pylist(), batch.column(kept + 1).to_pylist()):
        host = host_of(url)
        page = PlacedPage(Page(source or ""), host)
        if host:
            nodes.update(page.nodes)
            hosts.update(dict.fromkeys(page.nodes, host))
            pages.update(page.nodes.keys())
            styles.update(page.styles)
            for key, c in page.features.items():
                sums = features.setdefault(key, [0, 0.0])
                sums[0] += c
                sums[1] += c * math.log(c)
        left = list(page.candidates(names))
        texts.append([t for t, _, _ in left])
        leaves.append([n for _, n, _ in left])
        judged.append([bool(j and host) for _, _, j in left])
    columns = [*batch.columns[:kept], pa.array(texts, pa.list_(pa.string())), pa.array(leaves, pa.list_(pa.int64())), pa.array(judged, pa.list_(pa.bool_()))]
    table = pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:kept], "texts", "leaves", "judged"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_batch(table)
    order = list(nodes)
    return {
        "payload": zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes()),
        "node": order, "host": [hosts[n] for n in order], "name": [nodes[n][0] for n in order], "path": [nodes[n][1] for n in order],
        "style_in": [nodes[n][2] for n in order], "width": [nodes[n][3] for n in order], "pages": [pages[n] for n in order],
        "s_node": [n for n, _ in styles], "s_style": [s for _, s in styles], "s_count": list(styles.values()),
        "f_node": [n for n, _ in features], "f_key": [k for _, k in features], "f_count": [c for c, _ in features.values()], "f_log": [x for _, x in features.values()],
    }


def _zipped(chunks: DataFrame, columns: list[str]) -> DataFrame:
    entry = F.explode(F.arrays_zip(*columns)).alias("e")
    return chunks.select("chunk", entry).select("chunk", *[F.col(f"e.{c}").alias(c) for c in columns])


def _tree(chunks: DataFrame, threshold: float, least_pages: int, damping: float) -> DataFrame:
    """One row per node: host, node, name, path, pages, presentation, content, importance, noise."""
    per = _zipped(chunks, ["node", "host", "name", "path", "style_in", "width", "pages"])
    first = [F.first(c).alias(c) for c in ("host", "name", "path", "style_in", "width")]  # equal for equal nodes
    nodes = cut_lineage(per.groupBy("node").agg(*first, F.sum("pages").alias("pages")))

    styles = _zipped(chunks, ["s_node", "s_style", "s_count"]).groupBy("s_node", "s_style").agg(F.sum("s_count").alias("c"))
    spread = styles.groupBy("s_node").agg(F.sum("c").alias("all"), F.sum(F.expr("c * ln(c)")).alias("log"), F.count(F.lit(1)).alias("n_styles"))
    seen = _zipped(chunks, ["f_node", "f_key", "f_count", "f_log"]).groupBy("f_node", "f_key").agg(F.sum("f_count").alias("t"), F.sum("f_log").alias("x"))
    content = seen.groupBy("f_node").agg(F.avg(F.expr("ln(t) - x / t")).alias("entropy"))

    base = F.ln("pages")
    judged = F.col("pages") >= max(least_pages, 2)
    known = nodes.join(spread, F.col("node") == F.col("s_node"), "left").join(content, F.col("node") == F.col("f_node"), "left")
    known = known.withColumn("presentation", F.when(judged & F.col("all").isNotNull(), F.least(F.lit(1.0), F.expr("ln(all) - log / all") / base)))
    known = known.withColumn("content", F.when(judged & F.col("entropy").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("entropy") / base)))
    damp = F.pow(F.lit(damping), F.col("n_styles"))
    own = F.when(~judged, 1.0).when(F.col("n_styles").isNotNull(), (1 - damp) * F.col("presentation")).otherwise(F.coalesce("content", F.lit(0.0)))
    known = cut_lineage(known.select("node", "host", "name", "path", "style_in", "width", "pages", "presentation", "content", own.alias("own"), damp.alias("damp"), "all"))

    # the weight of an edge is the damping of the parent times the share of the style over its children
    parent = known.select(F.col("node").alias("up"), F.col("damp").alias("up_damp"), F.col("all").alias("up_all"))
    edge = known.filter(F.size("path") > 1).select("node", "style_in", "width", F.expr("path[size(path) - 2]").alias("up"))
    edge = edge.join(parent, "up").join(styles.select(F.col("s_node").alias("up"), F.col("s_style").alias("style_in"), "c"), ["up", "style_in"])
    edge = edge.select(F.col("node").alias("at"), F.ln(F.col("up_damp") * F.col("c") / F.col("up_all") / F.col("width")).alias("w"))
    steps = known.select("node", "own", F.posexplode("path").alias("place", "at")).join(edge, "at", "left")
    paths = steps.groupBy("node", "own").agg(F.sort_array(F.collect_list(F.struct("place", "at", "w"))).alias("steps"))
    part = "transform(steps, (x, i) -> struct(x.at as at, own * exp(aggregate(slice(steps, i + 2, size(steps)), 0D, (s, y) -> s + y.w)) as part))"
    rolled = paths.select(F.explode(F.expr(part)).alias("e")).groupBy(F.col("e.at").alias("node")).agg(F.sum("e.part").alias("importance"))
    valued = cut_lineage(known.drop("own", "damp", "all", "width", "style_in").join(rolled, "node"))
    peak = valued.select(F.explode("path").alias("node"), "importance").groupBy("node").agg(F.max("importance").alias("peak"))
    return valued.join(peak, "node").withColumn("noise", (F.col("peak") < threshold) & (F.col("pages") >= max(least_pages, 2))).drop("peak")


def site_tree(
    df: DataFrame, url: str = "url", html: str = "html", threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES, damping: float = DAMPING
) -> DataFrame:
    """The trees of all hosts, one row per element node, with its importances and whether its branch is noise."""
    ship_package(df.sparkSession)
    return _tree(_chunks(df, [], url, html, True), threshold, least_pages, damping)


def extract_main_text(
    df: DataFrame, keep: list[str] | None = None, url: str = "url", html: str = "html", threshold: float = THRESHOLD,
    least_pages: int = LEAST_PAGES, damping: float = DAMPING, names: bool = True,
) -> DataFrame:
    """One row per page: the kept columns and ``text``, its blocks in page order joined by line feeds."""
    ship_package(df.sparkSession)
    keep = ["page_id", "url"] if keep is None else keep
    chunks = _chunks(df, keep, url, html, names)
    noise = _tree(chunks, threshold, least_pages, damping).filter("noise").select("node")
    gone = chunks.select("chunk", F.explode("node").alias("node")).join(noise, "node").groupBy("chunk").agg(F.collect_list("node").alias("gone"))
    types = df.select(*[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)]).schema.fields
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in types] + ["_text string"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, gone in zip(batch.column(0), batch.column(1)):
                noise = set(gone.as_py() or ())
                with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload.as_py())) as reader:
                    table = reader.read_next_batch()
                rows = zip(*[table.column(c).to_pylist() for c in ("texts", "leaves", "judged")])
                texts = ["\n".join([t for t, n, j in zip(*row) if not (j and n in noise)]) for row in rows]
                kept = len(table.schema.names) - 3
                yield pa.RecordBatch.from_arrays([*table.columns[:kept], pa.array(texts, pa.string())], names=[*table.schema.names[:kept], "_text"])

    done = chunks.select("chunk", "payload").join(gone, "chunk", "left").select("payload", "gone").mapInArrow(finish, schema)
    return done.select(*[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)], F.col("_text").alias("text"))
