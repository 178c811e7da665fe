"""Main text of web pages by equivalence classes of template tokens.

Each page is parsed once into tokens: its tags (path of tag names and the element's own class words) and its blocks of text (path and
text). Over the different pages of a host, all of them and nothing else, a token's occurrence vector is how often it stands on each page. Spark aggregates it to
a fingerprint, so that hosts of any size and any partitioning give the same classes: tokens of one host with equal vectors are an equivalence class. A
class is valid if SUPPORT pages and SHARE_OF_HOST of the host's pages hold it and a tag is among its tokens. Valid classes nest: a text belongs to
the class of the element that holds it, and it is template text if it has that element's pages: all of them (its vector is that of a valid class) or, under an element of
most of the host's pages, nearly all. A class whose texts make up most of its pages' text is a group of copies of a page, no template.

Elements under navigation, forms, notices, adverts and the like are boilerplate. What is neither template text nor boilerplate are the slots, a page's
text. Where the page's own main or article elements hold most of that, what stands outside them goes, headings of the page excepted.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialise, table
from quire.llm.url_filter import host_of

#: Pages that a valid class must be on, at least, and share of its host's pages; share of an element's or a host's pages that hold a template text; share of
#: a class's pages' blocks from which on its texts are copies; share of a page's text that its main and article elements must hold to be all of it.
SUPPORT, SHARE_OF_HOST, NEARLY, COPIES, SHARE = 8, 0.01, 0.9, 2 / 3, 0.8
#: Template texts of all hosts up to which they are broadcast; pages of a batch.
MAX_BROADCAST = 200_000
PAGES = 200

# HTML element names and class words by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = set("head title nav header footer aside form script style noscript template svg iframe button select option textarea input label menu dialog object canvas audio video".split())
NOISE = re.compile(
    r"(?i)(^|[-_\s])(ads?|adverts?|advert\w*|banners?|sponsor\w*|promos?|promot\w*|comments?|comment-\w+|replies|disqus|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|sidebars?|side|widgets?|nav|navbar|navigation|menus?|breadcrumbs?|footers?|headers?|masthead|shar(e|es|ing)|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search|toolbar|pagination|pager|tags|skip|copyright|legal|disclaimer)([-_\s]|$)"
)
ROLES = set("navigation banner contentinfo complementary search alert dialog form".split())
#: Elements that hold the page; their class words say nothing about boilerplate.
HOLDERS = {"html", "body", "main", "article"}
CLOSES_P = BLOCK - {"br", "title", "body"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*>|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
_ATTR = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")


Block = tuple[int, int, bool, bool, str]  # token, token of the element that holds it, inside main or article, inside h1, text
LISTS = ("ul", "ol", "dl", "table")


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def parse(page: str) -> tuple[list[Block], Counter]:
    """The blocks of text outside boilerplate elements, in page order, and the tokens of its tags with their numbers. Elements left open are closed where
    HTML closes them. Scripts, styles and comments are gone. Time grows with the length of the page, whatever its depth."""
    stack: list[tuple[str, int, bool, int, bool, bool, int]] = []  # name, path, boilerplate, innermost element that is noise by name, in main, in h1, token
    root = ("", 0, False, 0, False, False, 0)
    at: dict[str, list[int]] = defaultdict(list)  # where elements of a name are open
    events: list[tuple | None] = []  # texts; None is a block's border
    tags: list[tuple[int, int]] = []  # token, innermost element that is noise by name
    above, sizes, marked = [0], [0], [0]  # of elements that are noise by name (0: the page): the one around, their text, and what of it is in main or article

    def close(upto: int) -> None:
        while len(stack) > upto:
            name = stack.pop()[0]
            at[name].pop()
            if name in BLOCK:
                events.append(None)

    for m in _TOKEN.finditer(page):
        t = m[0]
        if m[1] or t.startswith("<!") or t.startswith("<?"):
            continue
        found = _NAME.match(t)
        if not found or t[-1] != ">":
            _, path, noise, named, main, h1, token = stack[-1] if stack else root
            if not noise:
                events.append((t, path, token, named, main, h1))
                n = len(t.strip())
                sizes[named] += n
                marked[named] += n if main else 0
            continue
        tag = found[1].lower()
        if t[1] == "/":
            if at[tag]:
                close(at[tag][-1])
            elif tag in BLOCK:
                events.append(None)
            continue
        if tag in CLOSES_P and at["p"]:
            close(at["p"][-1])
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and at[tag] and all(not at[x] or at[x][-1] < at[tag][-1] for x in LISTS):
            close(at[tag][-1])
        attrs = [(a[0].lower(), a[1] or a[2] or a[3]) for a in _ATTR.findall(t[len(tag) + 1 :])]
        _, path, noise, named, main, h1, _ = stack[-1] if stack else root
        noise = noise or tag in DROPPED or any(k == "role" and v.lower() in ROLES for k, v in attrs)
        if tag not in HOLDERS and any(k != "role" and NOISE.search(v) for k, v in attrs):
            above.append(named)
            sizes.append(0)
            marked.append(0)
            named = len(above) - 1
        path = _hash(tag, path)
        words = sorted({w for k, v in attrs if k == "class" for w in v.split()})
        token = _hash(" ".join(words), path)
        if not noise:
            tags.append((token, named))
        if tag in BLOCK:
            events.append(None)
        if tag not in VOID and not t.endswith("/>"):
            at[tag].append(len(stack))
            stack.append((tag, path, noise, named, main or tag in ("article", "main"), h1 or tag == "h1", token))
    # the holder of most of the page's text is no boilerplate, whatever its name, unless an article or main stands beside it
    for e in range(len(above) - 1, 0, -1):
        sizes[above[e]] += sizes[e]
        marked[above[e]] += marked[e]
    bad = [False]
    for e in range(1, len(above)):
        bad.append(bad[above[e]] or not (2 * sizes[e] > sizes[0] and (marked[e] or not marked[0])))
    out: list[Block] = []
    held: list[str] = []
    first: tuple = ()
    for event in [*events, None]:
        if event is None:
            if held and (text := _SPACE.sub(" ", html.unescape("".join(held))).strip()):
                out.append((_signed(_hash(text, first[1])), _signed(first[2]), first[4], first[5], text))
            held = []
        elif not bad[event[3]]:
            if not held:
                first = event
            held.append(event[0])
    return out, Counter(_signed(token) for token, named in tags if not bad[named])


PARSED = "host string, page_id long, url string, page long, tags array<struct<token:long,n:int>>, blocks array<struct<token:long,owner:long,main:boolean,h1:boolean,text:string>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tag, block = pa.struct([("token", pa.int64()), ("n", pa.int32())]), pa.struct([("token", pa.int64()), ("owner", pa.int64()), ("main", pa.bool_()), ("h1", pa.bool_()), ("text", pa.string())])
    arrow = pa.schema([("host", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("page", pa.int64()), ("tags", pa.list_(tag)), ("blocks", pa.list_(block))])
    names = ("token", "owner", "main", "h1", "text")
    for batch in batches:
        for k in range(0, batch.num_rows, PAGES):
            some = batch.slice(k, PAGES)
            parsed = [parse(h or "") for h in some.column("html").to_pylist()]
            pages = [_signed(_hash(" ".join(str(b[0]) for b in blocks), len(blocks))) if blocks else None for blocks, _ in parsed]
            tags = [[{"token": t, "n": n} for t, n in sorted(own.items())] for _, own in parsed]
            blocks = [[dict(zip(names, b, strict=True)) for b in own] for own, _ in parsed]
            cols = [some.column("host"), some.column("page_id"), some.column("url"), pages, tags, blocks]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)


def templates(parsed: DataFrame) -> DataFrame:
    """host, token of the template texts of each host, from the tokens of all its different pages (PARSED)."""
    pages = parsed.where("page IS NOT NULL").select("host", "page", "tags", F.transform("blocks", lambda b: F.struct(b["token"].alias("token"), b["owner"].alias("owner"))).alias("texts")).dropDuplicates(["host", "page"])
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= SUPPORT)
    pages = pages.withColumn("blocks", F.size("texts"))
    tags = pages.select("host", "page", "blocks", F.inline("tags")).select("host", "page", "blocks", "token", "n", F.lit(None).cast("long").alias("owner"))
    texts = pages.select("host", "page", "blocks", F.inline("texts")).groupBy("host", "page", "token").agg(F.max("blocks").alias("blocks"), F.count("*").cast("int").alias("n"), F.min("owner").alias("owner"))
    rows = tags.unionByName(texts.select(tags.columns))
    vectors = rows.groupBy("host", "token").agg(F.count("*").alias("on"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.sum("n").alias("times"), F.sum("blocks").alias("blocks"), F.min("owner").alias("owner"))
    vectors = vectors.join(hosts, "host").where((F.col("on") >= SUPPORT) & (F.col("on") >= SHARE_OF_HOST * F.col("pages")))
    vectors = materialise(vectors, "vectors")
    is_text = F.col("owner").isNotNull()
    classes = vectors.groupBy("host", "vector").agg(F.count_if(~is_text).alias("tags"), F.sum(F.when(is_text, F.col("times"))).alias("text_times"), F.max("blocks").alias("class_blocks"))
    element = vectors.where(~is_text).select("host", F.col("token").alias("owner"), F.col("on").alias("element_on"))
    found = vectors.where(is_text).join(classes, ["host", "vector"]).join(element, ["host", "owner"], "left")
    own = (F.col("tags") > 0) & (F.col("text_times") <= COPIES * F.col("class_blocks"))
    nearly = (F.col("element_on") * 2 >= F.col("pages")) & (F.col("on") >= NEARLY * F.col("element_on"))
    flagged = found.withColumn("own", own).withColumn("nearly", nearly)
    # nearly all pages' texts, too, are copies where they are most of these pages' blocks
    copies = flagged.where("nearly").groupBy("host", "owner").agg(F.sum("times").alias("t"), F.max("blocks").alias("b")).where(F.col("t") > COPIES * F.col("b")).select("host", "owner", F.lit(True).alias("copied"))
    flagged = flagged.join(copies, ["host", "owner"], "left")
    return flagged.where("(own OR nearly) AND copied IS NULL AND (nearly OR own)").select("host", "token")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html).

    Null or empty html gives an empty text; null urls are pages of one host named by the empty string; repeated rows are kept each; other columns
    are ignored. On hosts of fewer than SUPPORT different pages nothing is template text."""
    keyed = pages.select(host_of(F.col("url")).alias("host"), "page_id", "url", "html")
    parsed = materialise(keyed.mapInArrow(_parse, PARSED), "parsed", PAGES)
    found = materialise(templates(parsed).groupBy("host").agg(F.collect_set("token").alias("template")), "templates")  # 1 / SHARE_OF_HOST times a page's blocks a host
    small = found.agg(F.coalesce(F.sum(F.size("template") + 4), F.lit(0))).first()[0] <= MAX_BROADCAST
    both = parsed.join(F.broadcast(found) if small else found, "host", "left")
    slots = both.withColumn("slots", F.filter("blocks", lambda b: F.col("template").isNull() | ~F.array_contains("template", b["token"])))
    length = lambda b: F.length(b["text"]).cast("long")
    total = F.aggregate("slots", F.lit(0).cast("long"), lambda n, b: n + length(b))
    inside = F.aggregate("slots", F.lit(0).cast("long"), lambda n, b: n + F.when(b["main"], length(b)).otherwise(F.lit(0).cast("long")))
    kept = F.when(inside >= SHARE * total, F.filter("slots", lambda b: b["main"] | b["h1"])).otherwise(F.col("slots"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return slots.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
