"""Main text of web pages by wrapper induction: DOM trees of one host are aligned by simple tree matching."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from deskweave.llm.common import read
from deskweave.llm.url_rules import url_parts
from deskweave.operators.staging import stage

LEAST = 3  # different pages that a layout's template is learned from, at least
CONSTANT = 0.9  # a text is template if this share of a layout's different pages have it at the same node
REPEATED = 0.1  # so it is under a word of APART_WORDS inside an article if this share have it
DEPTH = 400  # levels of a page's tree that are aligned; what is nested deeper stays content of what holds it
FRAME = 4  # levels of a page's tree, without the inside of its article, that make its layout
BROADCAST_BYTES = 32 << 20  # wrappers of all hosts together; more are joined by shuffle
RESIDENT_WRAPPERS = 256  # parsed ones a task keeps

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body table ul ol dl td th article section div main nav aside header footer form".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# What is never part of an article, by element and by a word of class, id or role.
APART = frozenset("nav footer aside form script style noscript template button select textarea title head iframe svg canvas object dialog menu".split())
APART_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|footer|sidebar|side|aside|ad|ads|advert|advertisement|advertising|sponsor|sponsored|banner|cookie|cookies|consent|notice|"
    r"alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|related|recommended|comment|comments|respond|disqus|breadcrumb|breadcrumbs|"
    r"pagination|pager|promo|widget|toolbar|search|login|complementary|contentinfo|hidden)(?:$|[\s_\d-])"
)
MAIN_WORDS = re.compile(r"(?:^|\s)(?:main|articlebody|article-body|article-content|post-content|entry-content|main-content)(?:$|\s)")

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<!--|<[!?/][^>]*>")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.IGNORECASE)


class Node:
    """An element; ``parts`` are its texts and children in page order."""

    __slots__ = ("tag", "name", "apart", "named", "main", "parts", "digest", "texts", "chars")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.parts = tag, []
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        words = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop"))
        self.name = f"{tag}.{found.get('class', '')}"
        self.main = tag in ("article", "main") or bool(words and MAIN_WORDS.search(words))
        unseen = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "")
        named = bool(words.strip()) and tag not in ("html", "body") and bool(APART_WORDS.search(words))
        self.apart = tag in APART or unseen or named
        self.named = named and tag not in APART and not unseen  # set apart by a word only

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def parse(text: str) -> Node:
    """A tree of any text; unclosed, misnested and cut-off elements end with what contains them."""
    root = Node("#root")
    stack = [root]
    at, size = 0, len(text)
    while at < size:
        match = TAG.search(text, at)
        if not match:
            break
        if match.start() > at:
            stack[-1].parts.append(text[at : match.start()])
        at = match.end()
        if match[0] == "<!--":
            end = text.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        if match[1] or match[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES and tag not in SCOPES:
                    break
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in CLOSES.get(tag, ()) or tag in ENDS_P and stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in SCOPES:
                break
        node = Node(tag, match[3] or match[6] or "")
        stack[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(text, at)
            at = end.end() if end else size
            continue
        stack.append(node)
    if at < size:
        stack[-1].parts.append(text[at:])
    return root


MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687


def summarise(root: Node, drop: set[int] = frozenset()) -> None:
    """For every block node the number of its ``blocks``, their characters, and a hash of them in order; in one pass, from the
    leaves up: a parent's hash follows from its children's, as digits of a number follow from those of its parts."""
    frames: list[list] = [[root, iter(root.parts), 0, 0, 0, []]]  # node, parts, hash, texts, characters, open line

    def close(frame: list) -> None:
        if frame[5]:
            text = " ".join(html.unescape("".join(frame[5])).split())
            frame[5].clear()
            if text:
                digest = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=7).digest(), "big") + 1
                frame[2], frame[3], frame[4] = (frame[2] * BASE + digest) % MODULUS, frame[3] + 1, frame[4] + len(text)

    def inside(node: Node, apart: bool) -> Iterator:
        """Parts of a node, those of inline elements in their place; texts of inline nodes set apart are left out."""
        for part in node.parts:
            if isinstance(part, Node) and part.tag in INLINE and part.tag != "br":
                hidden = apart or part.apart or id(part) in drop
                nested = [(p, hidden) for p in part.parts]
                todo = list(reversed(nested))
                while todo:
                    item, off = todo.pop()
                    if isinstance(item, Node) and item.tag in INLINE and item.tag != "br":
                        off_here = off or item.apart or id(item) in drop
                        todo.extend((q, off_here) for q in reversed(item.parts))
                    elif not off:
                        yield item
            else:
                yield part

    frames[0][1] = inside(root, False)
    while frames:
        frame = frames[-1]
        part = next(frame[1], None)
        if part is None:
            close(frame)
            node = frame[0]
            node.digest, node.texts, node.chars = frame[2], frame[3], frame[4]
            frames.pop()
            if frames and not node.apart and id(node) not in drop and node.texts:
                up = frames[-1]
                up[2] = (up[2] * pow(BASE, node.texts, MODULUS) + node.digest) % MODULUS
                up[3], up[4] = up[3] + node.texts, up[4] + node.chars
        elif isinstance(part, str):
            frame[5].append(part)
        elif part.tag == "br":
            frame[5].append(" ")
        else:
            close(frame)
            frames.append([part, inside(part, False), 0, 0, 0, []])


def blocks(node: Node, drop: set[int], keep: set[int] = frozenset()) -> list[str]:
    """Texts between block borders in page order, white space made one space; without nodes set apart, unless in ``keep``."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    # A stack of what is still to come, so that deep nesting needs no recursion.
    todo: list = list(reversed(node.parts))
    while todo:
        part = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            line.append(part)
        elif part.tag == "br":
            line.append(" ")
        elif part.apart and id(part) not in keep or id(part) in drop:
            if part.tag not in INLINE:
                close()
        elif part.tag in INLINE:
            todo.extend(reversed(part.parts))
        else:
            close()
            todo.append(None)
            todo.extend(reversed(part.parts))
    close()
    return out


class Group:
    """A run of siblings of one name, the unit of alignment: repeated items count once."""

    __slots__ = ("name", "nodes", "groups", "marks", "shape")

    def __init__(self, nodes: list[Node], deep: int = 0) -> None:
        self.name, self.nodes = nodes[0].name, nodes
        children = [c for n in nodes for c in n.children() if c.tag not in INLINE] if deep < DEPTH else []
        self.groups: list[Group] = []
        run: list[Node] = []
        for child in children:
            if run and child.name != run[-1].name:
                self.groups.append(Group(run, deep + 1))
                run = []
            run.append(child)
        if run:
            self.groups.append(Group(run, deep + 1))
        self.marks = [mark(n) for n in nodes]
        self.shape = hashlib.blake2b("\n".join([self.name, *[g.shape for g in self.groups]]).encode("utf-8", "replace"), digest_size=8).hexdigest()

    def record(self) -> list:
        return [self.name, [g.record() for g in self.groups]]

    def walk(self) -> Iterator[tuple[str, Group]]:
        """All groups with their paths, places among siblings joined by dots."""
        todo = [("", self)]
        while todo:
            path, group = todo.pop()
            yield path, group
            todo.extend((f"{path}.{i}", g) for i, g in enumerate(group.groups))


def mark(node: Node) -> int:
    """A hash of the texts of a summarised node, 0 without any."""
    return node.digest if node.texts else 0


def tree(text: str) -> Group:
    root = parse(text)
    summarise(root)
    return Group([root])


def matching(a: list, b: list, memo: dict) -> int:
    """Simple tree matching of records [name, groups]: the most pairs that keep names, order and ancestry."""
    key = (id(a), id(b))
    if key not in memo:
        if a[0] != b[0]:
            memo[key] = 0
        else:
            row = [0] * (len(b[1]) + 1)
            for x in a[1]:
                last, row = row, [0]
                for j, y in enumerate(b[1]):
                    row.append(max(row[j], last[j + 1], last[j] + matching(x, y, memo)))
            memo[key] = row[-1] + 1
    return memo[key]


def aligned(a: list, b: list, memo: dict | None = None) -> list[tuple[list, list]]:
    """The matched pairs of records of a best matching, roots first."""
    memo = {} if memo is None else memo
    if not matching(a, b, memo):
        return []
    n, m = len(a[1]), len(b[1])
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + matching(a[1][i], b[1][j], memo))
    pairs: list[tuple[list, list]] = []
    i, j = n, m
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            pairs += aligned(a[1][i - 1], b[1][j - 1], memo)
            i, j = i - 1, j - 1
    return [(a, b), *pairs]


def article(page: Group) -> Node | None:
    """The element with the most text of those that a page calls its article; of nested ones of equal text the outer one."""
    found: list[tuple[int, Node]] = []
    todo = [page]
    while todo:
        group = todo.pop()
        for node in group.nodes:
            if node.main and not node.apart:
                found.append((node.chars, node))
        if not group.nodes[0].apart:
            todo.extend(reversed(group.groups))
    return max(found, key=lambda f: f[0])[1] if found else None


def layout(page: Group, main: Node | None) -> str:
    """A hash of the first levels of the page's shape, without the inside of its article."""

    def frame(group: Group, levels: int) -> str:
        inside = levels and not any(n is main for n in group.nodes)
        return f"{group.name}({','.join(frame(g, levels - 1) for g in group.groups) if inside else ''})"

    return hashlib.blake2b(frame(page, FRAME).encode("utf-8", "replace"), digest_size=8).hexdigest()


def places(record: list, base: list) -> dict[str, str]:
    """Paths of the record's groups to the paths of those of ``base`` that a best matching pairs them with."""

    def paths(top: list) -> dict[int, str]:
        out, todo = {}, [("", top)]
        while todo:
            path, r = todo.pop()
            out[id(r)] = path
            todo.extend((f"{path}.{i}", g) for i, g in enumerate(r[1]))
        return out

    mine, theirs = paths(record), paths(base)
    return {mine[id(x)]: theirs[id(y)] for x, y in aligned(record, base)}


class Wrapper:
    """Of a host, by layout: the record that pages are aligned with, and the texts that repeat at its nodes."""

    def __init__(self, text: str | None) -> None:
        self.layouts = {w["layout"]: (json.loads(w["base"]), {(r["path"], int(r["mark"])): r["constant"] for r in w["repeated"] if r["mark"] != "0"}, {r["path"] for r in w["repeated"]}) for w in json.loads(text or "[]")}
        self.pairs: dict[tuple[str, str], dict[str, str]] = {}

    def template(self, page: Group, main: Node | None) -> tuple[set[int], set[int]]:
        """Page nodes that are template, and those set apart by a word only whose text does not repeat."""
        drop: set[int] = set()
        keep: set[int] = set()
        name = layout(page, main)
        if name not in self.layouts:
            # Nothing was learned: words alone take nothing out of an article.
            keep.update(id(n) for _, group in page.walk() for n in group.nodes if n.named)
            return drop, keep
        base, repeated, learned = self.layouts[name]
        if (name, page.shape) not in self.pairs:
            # Pages of one shape align alike, so the matching is made once for each shape.
            self.pairs[name, page.shape] = places(page.record(), base)
        known = self.pairs[name, page.shape]
        for path, group in page.walk():
            if known.get(path) not in learned:
                continue
            for node, text in zip(group.nodes, group.marks):
                constant = repeated.get((known[path], text))
                if constant or constant is not None and node.named:
                    drop.add(id(node))
                elif node.named and text:
                    keep.add(id(node))
        return drop, keep


def main_text(text: str, wrapper: Wrapper) -> str:
    """Blocks of the page's content joined by an empty line.

    Content is what the page calls its article, without template nodes; parts that only a word sets apart stay
    in it where the host shows that their texts do not repeat, or shows nothing. Without such an element the content is what
    varies: from the body down to the last node that holds four fifths of all text in slots, without template nodes.
    """
    page = tree(text)
    main = article(page)
    drop, keep = wrapper.template(page, main)
    if main:
        return "\n\n".join(blocks(main, drop, keep))

    root = page.nodes[0]
    summarise(root, drop)

    def varying(group: Group) -> int:
        return sum(n.chars for n in group.nodes if not n.apart and id(n) not in drop)

    region, total = page, varying(page)
    while total:
        inner = next((g for g in region.groups if len(g.nodes) == 1 and varying(g) >= 0.8 * total), None)
        if inner is None or inner.nodes[0].apart or id(inner.nodes[0]) in drop:
            break
        region = inner
    found = [t for n in region.nodes for t in blocks(Node("#region") if n.apart else n, drop)]
    # A page all of whose text only a word sets apart has that text.
    return "\n\n".join(found or blocks(root, drop, keep))


TRAITS = "host string, layout string, identity long, size int, record string, paths array<string>, marks array<long>"


def _traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its layout, what tells copies (the text of its article, or else of the page), and the texts at its nodes."""
    schema = pa.schema([("host", pa.string()), ("layout", pa.string()), ("identity", pa.int64()), ("size", pa.int32()), ("record", pa.string()), ("paths", pa.list_(pa.string())), ("marks", pa.list_(pa.int64()))])
    for batch in batches:
        rows = []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html")):
            page = tree(text.as_py())
            main, groups = article(page), list(page.walk())
            seen = dict.fromkeys((path, m) for path, g in groups for m in g.marks)
            record = json.dumps(page.record(), separators=(",", ":"))
            rows.append((host, layout(page, main), mark(main) if main else page.marks[0], len(groups), record, [p for p, _ in seen], [m for _, m in seen]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, layout, path, mark) in the paths of the layout's base, for each page once; one with mark 0 for each path."""
    known: dict[tuple[str, str], dict[str, str]] = {}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            key = (r["record"], r["base"])
            if key not in known:
                if len(known) >= 16 * RESIDENT_WRAPPERS:
                    known.clear()
                known[key] = places(*map(json.loads, key))
            at = known[key]
            found = [(at[p], m) for p, m in zip(r["paths"], r["marks"]) if p in at]
            rows += [(r["host"], r["layout"], *x) for x in {*found, *((p, 0) for p, _ in found)}]
        names = ["host", "layout", "path", "mark"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, [pa.string()] * 3 + [pa.int64()])], names=names)


def _extracted(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Wrapper] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column("html"), batch.column("wrapper")):
            name = wrapper.as_py() or ""
            if name not in known:
                if len(known) >= RESIDENT_WRAPPERS:
                    known.clear()
                known[name] = Wrapper(name)
            texts.append(main_text(page.as_py() or "", known[name]))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.string())], names=[*keys, "text"])


def _small(df: DataFrame, *columns: str) -> DataFrame:
    """A hint to broadcast a written table that is small enough."""
    size = df.agg(F.sum(sum((F.length(c) for c in columns), F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def learn(hosted: DataFrame) -> DataFrame:
    """(host, wrapper) from all of ``hosted(host, html)``.

    Pages of one host and layout whose articles (without one: whole texts) are equal count once. The layout's
    largest tree is its base; every page is aligned with it by simple tree matching, and for each node the
    different pages that have it, and each text there, are counted map-side first. So no group is held by one task.
    """
    traits = hosted.where("trim(html) <> ''").select("host", "html").mapInArrow(_traits, TRAITS)
    one = traits.groupBy("host", "layout", "identity").agg(F.max(F.struct("size", "record", "paths", "marks")).alias("r"))
    pages = stage(one.select("host", "layout", "r.*"), "page-traits")
    bases = pages.groupBy("host", "layout").agg(F.count("*").alias("n"), F.max(F.struct("size", "record")).alias("b"))
    bases = stage(bases.where(F.col("n") >= LEAST).select("host", "layout", F.col("b.record").alias("base")), "layouts")
    pages = pages.join(_small(bases, "host", "base"), ["host", "layout"])
    counts = pages.mapInArrow(_aligned, "host string, layout string, path string, mark long").groupBy("host", "layout", "path", "mark").agg(F.count("*").alias("n"))
    counts = stage(counts, "node-texts")
    every = counts.where((F.col("mark") == 0) & (F.col("n") >= LEAST)).select("host", "layout", "path", F.col("n").alias("all"))
    texts = counts.where("n > 1 or mark = 0").join(every, ["host", "layout", "path"]).where((F.col("n") >= F.col("all") * REPEATED) & (F.col("n") > 1))
    one = F.struct("path", F.col("mark").cast("string").alias("mark"), ((F.col("mark") != 0) & (F.col("n") >= F.col("all") * CONSTANT)).alias("constant"))
    found = texts.groupBy("host", "layout").agg(F.sort_array(F.collect_list(one)).alias("repeated"))
    return found.join(bases, ["host", "layout"]).groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("layout", "base", "repeated")))).alias("wrapper"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of ``pages(page_id, url, html)``.

    Every page is aligned with the wrapper that ``learn`` makes of all pages of its host. Wrappers are broadcast while
    all together are below BROADCAST_BYTES and joined by host beyond; either way pages are processed one by one, whole.

    A null or empty html has an empty text; a null url belongs to the empty host. Repeated rows are
    extracted each; an empty table gives no rows; other columns are not read.
    """
    pages = pages.select("page_id", "url", "html")
    hosted = pages.withColumn("host", url_parts(F.col("url"))[0])
    wrappers = stage(learn(hosted), "wrappers")
    joined = hosted.join(_small(wrappers, "host", "wrapper"), "host", "left").select(*pages.columns, "wrapper")
    schema = StructType([*pages.select("page_id", "url").schema.fields, StructField("text", StringType())])
    return joined.mapInArrow(lambda b: _extracted(b, ["page_id", "url"]), schema)


def op6_tree_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
