"""Main text of HTML pages by equivalence classes of tokens over the pages of a host.

A token is a tag with its place in the tree, or a whole text node with its place. Tokens with one occurrence vector
over a host's pages (how often each page has them) form an equivalence class; classes that enough pages have and whose
tokens nest in one another are the host's template. What stands between its tokens are slots. All slots of a page but
menus are extracted, or its main elements where they hold more than any other slot; notices and whatever else the template
or the markup marks as no part of the article are not. Copies of a page are one page of the host.

An occurrence vector is as long as a host has pages, so it is never built: each token gets a digest of it, a sum over
pages that is combined before the shuffle.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scratch import Scratch, batches_of

# The elements of HTML without content, those that stand within a line, and those that are no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
SILENT = frozenset(
    "head title script style noscript template nav header footer aside form button select option textarea input "
    "iframe object svg canvas audio video dialog menu".split()
)
# Words in a class or an id that mark an element as no part of the article. Within a main element a name of several words
# (section-header, share-price) is taken as a name of its own and marks nothing, unless its last word says what it holds.
HINT = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice\w*|gdpr|popup|modal|overlay"
    r"|menu\w*|nav\w*|breadcrumb\w*|header|masthead|footer|sidebar|aside|widget\w*|related|recommend\w*|share\w*"
    r"|social\w*|comment\w*|discussion|disqus|repl(?:y|ies)|newsletter|subscribe\w*|signup|login|search\w*|pager"
    r"|pagination|toolbar|skip)(?:[^a-z]|$)"
)
MAIN = frozenset(("article", "main"))
INNER_HINT = re.compile(
    r"(?:^|.*[-_])(?:ads?|advert\w*|banner|sponsored|promo|cookies?|consent|popup|modal|menu|nav|navigation|breadcrumbs?"
    r"|footer|sidebar|widget|related|comments?|replies|disqus|newsletter|signup|pagination|toolbar)$"
    r"|^(?:share|social|comment|reply|related|newsletter|header|search|login|subscribe|notice)$"
    r"|^(?:comments?|share|social|related|newsletter)[-_](?:list|box|buttons?|links?|posts?|bar|section|thread|body|item)$"
)
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\">]*\"|'[^'>]*')*+)>|<[!?/A-Za-z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")


@dataclass(frozen=True)
class TemplateOptions:
    """A class belongs to the template if at least ``percent`` percent of a host's pages have it. Text that stands at
    one place of ``text_percent`` percent of at least ``text_pages`` pages is template too. The templates of all hosts
    are broadcast up to ``broadcast_hosts`` hosts and met by a salted shuffle beyond."""

    percent: int = 50
    text_percent: int = 80
    text_pages: int = 10
    broadcast_hosts: int = 20_000


def element(name: str, attributes: str) -> str:
    """An element's name with its class, id and role; numbers in them do not count."""
    if "=" not in attributes:
        return name
    marks = []
    for match in _NAMED.finditer(attributes):
        value = match.group(2) or match.group(3) or match.group(4) or ""
        marks.append(f"{match.group(1).lower()}:{_DIGITS.sub('0', value.lower())}")
    return f"{name}[{' '.join(marks)}]" if marks else name


def silent(name: str, marks: str, inner: bool) -> bool:
    """Whether an element is no part of an article, by its name, class, id and role. ``inner``: it is in a main element."""
    if name in SILENT:
        return name != "header" or not inner
    if not marks or name in ("html", "body", "main"):
        return False
    words = marks.replace(":", " ").split()
    if inner or name == "article":
        return any(INNER_HINT.match(word) for word in words)
    return HINT.search(" ".join(words)) is not None


class Place:
    """An element of a page with all elements around it. ``key`` is a digest of the path, made from the parent's, so the
    places of a page take memory by their number, however deep they are."""

    __slots__ = ("parent", "name", "key", "silent", "main")

    def __init__(self, parent: Place | None, part: str) -> None:
        name, _, marks = part.partition("[")
        self.parent, self.name = parent, name
        above = parent.key if parent else ""
        self.key = hashlib.blake2b(f"{above}/{part}".encode(), digest_size=8).hexdigest()
        inner = parent is not None and parent.main
        self.silent = (parent is not None and parent.silent) or silent(name, marks[:-1], inner)
        self.main = inner or name in MAIN


Block = tuple[Place | None, str, bool, list[str]]


def blocks(page: str) -> Iterator[Block]:
    """The blocks of a page in order: place, text, whether it is all links, and the tags before it.

    Tags give as tokens the keys of the place around them and of their own. A paragraph ends where the next block element
    begins.
    """
    path: list[Place] = []
    children: dict[tuple[str, str], Place] = {}
    opened: Counter[str] = Counter()
    held: list[tuple[str, bool]] = []
    tags: list[str] = []
    links = 0

    def flush():
        nonlocal tags
        text = " ".join(html.unescape("".join(part for part, _ in held)).split()) if held else ""
        linked = bool(held) and all(inside for part, inside in held if part.strip())
        held.clear()
        if text or tags:
            result = (path[-1] if path else None, text, linked, tags)
            tags = []
            return result
        return None

    def close(place: int) -> None:
        for part in path[place:]:
            opened[part.name] -= 1
        del path[place:]

    at = 0
    for match in _MARKUP.finditer(page):
        if match.start() > at:
            held.append((page[at : match.start()], links > 0))
        at = match.end()
        name = match.group(3)
        if name is None:
            continue
        name = name.lower()
        closing = bool(match.group(2))
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        block = flush()
        if block:
            yield block
        links = 0
        if name in VOID:
            continue
        if not closing:
            # A block element ends an open paragraph, an item the item before it.
            for ended in ("p", "li") if name == "li" else ("p",):
                for place in range(len(path) - 1, -1, -1) if opened[ended] else ():
                    if path[place].name == ended:
                        close(place)
                        break
                    if path[place].name in ("ul", "ol", "td", "div", "article"):
                        break
            part = element(name, match.group(4) or "")
            parent = path[-1] if path else None
            above = parent.key if parent else ""
            node = children.get((above, part))
            if node is None:
                node = children[above, part] = Place(parent, part)
            tags.append(f"{above}<{node.key}")
            path.append(node)
            opened[name] += 1
        elif opened[name]:
            place = len(path) - 1
            while path[place].name != name:
                place -= 1
            tags.append(f"{path[place - 1].key if place else ''}>{path[place].key}")
            close(place)
    if at < len(page):
        held.append((page[at:], links > 0))
    block = flush()
    if block:
        yield block


def shown(page: str) -> Iterator[tuple[Place | None, str, bool]]:
    """The blocks with text that may be part of an article."""
    for place, text, linked, _ in blocks(page):
        if text and not (place and place.silent):
            yield place, text, linked


# Groups of copied pages whose digests are broadcast (about 50 bytes each); beyond, pages meet them by a shuffle.
BROADCAST_COPIES = 500_000
# Sums of billions of digests stay below 2 ** 63.
_PRIME = (1 << 31) - 1
COUNTED = "host string, token string, pages long, times long, vector_one long, vector_two long"


def text_token(place: Place | None, text: str) -> str:
    """A block of text at its place, as a digest. Tokens of tags have 34 signs at most, those of texts 40."""
    return hashlib.blake2b(f"{place.key if place else ''}={text}".encode("utf-8", "replace"), digest_size=20).hexdigest()


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, host and token: pages that have it, how often they do, and a digest of its occurrence vector."""
    held: dict[tuple[str | None, str], list[int]] = {}

    def result() -> pa.RecordBatch:
        rows = [(*key, *values) for key, values in held.items()]
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string()] * 2 + [pa.int64()] * 4
        names = [part.split()[0] for part in COUNTED.split(", ")]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for whole in batches:
        for batch in batches_of(whole, "html"):
            hosts = batch.column("host").to_pylist()
            marks = batch.column("mark").to_numpy()
            for host, mark, page in zip(hosts, marks.tolist(), batch.column("html").to_pylist()):
                counts: Counter[str] = Counter()
                for place, text, _, tags in blocks(page or ""):
                    counts.update(tags)
                    if text and not (place and place.silent):
                        counts[text_token(place, text)] += 1
                for token, times in counts.items():
                    values = held.setdefault((host, token), [0, 0, 0, 0])
                    # Digests add up modulo a prime, so they cannot overflow.
                    values[0] += 1
                    values[1] += times
                    values[2] = (values[2] + (mark % _PRIME) * times) % _PRIME
                    values[3] = (values[3] + (mark * 0x9E3779B97F4A7C15 >> 7) % _PRIME * times) % _PRIME
            if len(held) > 50_000:
                yield result()
    yield result()


def token_counts(pages: DataFrame) -> DataFrame:
    """Counts and occurrence-vector digests of each token of each host, over all pages."""
    counted = pages.mapInArrow(_counting, COUNTED)
    return counted.groupBy("host", "token").agg(
        *(F.sum(name).alias(name) for name in ("pages", "times")),
        *((F.sum(name) % _PRIME).alias(name) for name in ("vector_one", "vector_two")),
    )


def once_each(rows: DataFrame) -> DataFrame:
    """Pages without their copies: one page of each host and html. Only pages that have copies are shuffled, one of each a
    task."""
    hashed = rows.withColumn("digest", F.xxhash64("html"))
    copied = hashed.groupBy("host", "digest").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    copied = copied.withColumnsRenamed({"host": "host_of", "digest": "digest_of"})
    copied = Scratch(rows.sparkSession, "copies").write(copied, "copied")
    if copied.count() <= BROADCAST_COPIES:
        copied = F.broadcast(copied)
    same = F.col("host").eqNullSafe(F.col("host_of")) & (F.col("digest") == F.col("digest_of"))
    first = hashed.join(copied, same, "left_semi").groupBy("host", "digest").agg(
        F.min("mark").alias("mark"), F.first("html").alias("html")
    )
    alone = hashed.join(copied, same, "left_anti")
    return alone.select("host", "mark", "html").unionByName(first.select("host", "mark", "html"))


def slot_of(place: Place | None, skeleton: frozenset[str], known: dict[str, str]) -> str:
    """Key of the deepest element around a text that is in the template; elements of it are with all around them.
    ``known`` has the slots of a page found so far, so no element is passed twice."""
    passed = []
    while place is not None and place.key not in skeleton and place.key not in known:
        passed.append(place.key)
        place = place.parent
    found = known.get(place.key, place.key) if place else ""
    known.update(dict.fromkeys(passed, found))
    return found


def template_of(rows: list[dict], host_pages: int, options: TemplateOptions) -> tuple[list[str], list[str]]:
    """Keys of the elements that are in the host's template, and the text tokens that are template.

    ``rows`` are the host's tokens that enough pages have. Classes of tags with one occurrence vector are valid if enough
    pages have them and more than one token is in them; an element is in the template if its tag is in a valid class of
    single occurrences and all elements around it are, too. The slots are the deepest such elements around texts.
    """
    classes: dict[tuple, list[str]] = {}
    for row in rows:
        if "<" in row["token"] or ">" in row["token"]:
            if 100 * row["pages"] >= options.percent * host_pages:
                vector = (row["pages"], row["times"], row["vector_one"], row["vector_two"])
                classes.setdefault(vector, []).append(row["token"])
    around: dict[str, str] = {}
    for (pages, times, _, _), tokens in classes.items():
        if len(tokens) > 1 and pages == times:
            for token in tokens:
                above, opens, key = token.partition("<")
                if opens:
                    around[key] = above
    inside = {above: [key for key in around if around[key] == above] for above in set(around.values())}
    skeleton, open_keys = [], [""]
    while open_keys:
        found = inside.get(open_keys.pop(), [])
        skeleton += found
        open_keys += found
    fixed = [
        row["token"]
        for row in rows
        if "<" not in row["token"]
        and ">" not in row["token"]
        and host_pages >= options.text_pages
        and 100 * row["pages"] >= options.text_percent * host_pages
    ]
    return sorted(skeleton), sorted(fixed)


TEMPLATE = "host string, skeleton array<string>, fixed array<string>"


def _deducing(options: TemplateOptions):
    def task(table: pa.Table) -> pa.Table:
        host_pages = table.column("host_pages")[0].as_py()
        skeleton, fixed = template_of(table.to_pylist(), host_pages, options)
        kind = pa.list_(pa.string())
        return pa.table(
            {
                "host": table.column("host").slice(0, 1),
                "skeleton": pa.array([skeleton], kind),
                "fixed": pa.array([fixed], kind),
            }
        )

    return task


def templates(pages: DataFrame, options: TemplateOptions) -> DataFrame:
    """``host``, ``skeleton`` and ``fixed``: a row per host, from its pages without copies. Tokens that too few pages have
    are left out before tokens of a host meet: what meets is at most the tokens of a few of its pages, however many."""
    hosts = pages.groupBy("host").agg(F.count_distinct(F.xxhash64("html")).alias("host_pages"))
    hosts = hosts.withColumnRenamed("host", "host_of")
    counted = token_counts(once_each(pages)).join(hosts, F.col("host").eqNullSafe(F.col("host_of")))
    is_tag = F.col("token").rlike("[<>]")
    percent = F.when(is_tag, options.percent).otherwise(options.text_percent)
    enough = (100 * F.col("pages") >= percent * F.col("host_pages")) & (
        is_tag | (F.col("host_pages") >= options.text_pages)
    )
    return counted.filter(enough).drop("host_of").groupBy("host").applyInArrow(_deducing(options), TEMPLATE)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, and words in links, of each slot of each page's host."""
    for batch, rows in _templated(batches, ("skeleton",)):
        sums: dict[tuple[str | None, str], list[int]] = {}
        for host, page, skeleton in rows:
            known: dict[str, str] = {}
            for place, text, linked in shown(page):
                values = sums.setdefault((host, slot_of(place, skeleton, known)), [0, 0])
                number = text.count(" ") + 1
                values[0] += number
                values[1] += number * linked
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([host for host, _ in sums], pa.string()),
                pa.array([slot for _, slot in sums], pa.string()),
                pa.array([values[0] for values in sums.values()], pa.int64()),
                pa.array([values[1] for values in sums.values()], pa.int64()),
            ],
            ["host", "slot", "words", "linked"],
        )


def with_menus(joined: DataFrame, found: DataFrame) -> DataFrame:
    """Templates with ``menus``: slots most of whose words, over all pages of the host, are in links."""
    counted = joined.select("html", "host", "skeleton").mapInArrow(_words, "host string, slot string, words long, linked long")
    summed = counted.groupBy("host", "slot").agg(F.sum("words").alias("words"), F.sum("linked").alias("linked"))
    menus = summed.filter(2 * F.col("linked") > F.col("words")).groupBy("host").agg(F.collect_list("slot").alias("menus"))
    menus = menus.withColumnRenamed("host", "menu_host")
    kept = found.join(menus, F.col("host_of").eqNullSafe(F.col("menu_host")), "left").drop("menu_host")
    return kept.withColumn("menus", F.coalesce("menus", F.array().cast("array<string>")))


def article(page: str, skeleton: frozenset[str], menus: frozenset[str], fixed: frozenset[str]) -> str:
    """The text of a page's article, blocks joined by one space.

    That is the text of all slots, whatever their share of the host's words, but those that are menus: most of their words
    are in links, over the host and on this page. Where main elements hold more words than any other such slot, it is what
    they hold; text in them is no template for being on many pages.
    """
    known: dict[str, str] = {}
    held = [
        (slot_of(place, skeleton, known), place is not None and place.main, text, linked)
        for place, text, linked in shown(page)
        if (place and place.main) or text_token(place, text) not in fixed
    ]
    sums: dict[tuple[str, bool], list[int]] = {}
    for slot, main, text, linked in held:
        values = sums.setdefault((slot, main), [0, 0])
        number = text.count(" ") + 1
        values[0] += number
        values[1] += number * linked
    menu = {
        (slot, main)
        for (slot, main), (words, linked) in sums.items()
        if not main and slot in menus and 2 * linked > words
    }
    inner = sum(words for (_, main), (words, _) in sums.items() if main)
    outer = max((words for key, (words, _) in sums.items() if not key[1] and key not in menu), default=0)
    if inner >= max(outer, 1):
        return " ".join(text for _, main, text, _ in held if main)
    return " ".join(text for slot, main, text, _ in held if (slot, main) not in menu)


EXTRACTED = "page_id long, url string, text string, n_chars long"


def _templated(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """Slices of batches with their rows: host, page and, as sets, the named parts of the host's template."""
    known: dict[str | None, tuple[frozenset[str], ...]] = {}
    for whole in batches:
        for batch in batches_of(whole, "html"):
            rows = []
            hosts = batch.column("host").to_pylist()
            for place, (host, page) in enumerate(zip(hosts, batch.column("html").to_pylist())):
                if host not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[host] = tuple(frozenset(batch.column(name)[place].as_py() or ()) for name in names)
                rows.append((host, page or "", *known[host]))
            yield batch, rows


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rows in _templated(batches, ("skeleton", "menus", "fixed")):
        texts = [article(page, skeleton, menus, fixed) for _, page, skeleton, menus, fixed in rows]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(text) for text in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )


SALTS = 64


def extract(pages: DataFrame, options: TemplateOptions | None = None) -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``url``, ``text`` of its article and ``n_chars``, its code points.

    Cases: a null or empty page has empty text; a null url, or one without host, belongs to a host of its own, all of
    whose pages share one template; a host of one page has a template from that page; copies of a page count as one page of the
    host and give a row each; a page cut short gives what it has; an empty table gives no rows; other columns are ignored.
    """
    options = options or TemplateOptions()
    scratch = Scratch(pages.sparkSession, "templates")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "html",
        host.alias("host"),
        F.pmod(F.xxhash64("page_id", "url", "html"), F.lit((1 << 62) + 1)).alias("mark"),
    )
    found = scratch.write(templates(rows.select("host", "mark", "html"), options), "templates")
    found = found.withColumnRenamed("host", "host_of")
    few = found.count() <= options.broadcast_hosts
    found = scratch.write(with_menus(_met(rows, found, few), found), "menus")
    joined = _met(rows, found, few)
    return joined.select("page_id", "url", "html", "host", "skeleton", "menus", "fixed").mapInArrow(_extracting, EXTRACTED)


def _met(rows: DataFrame, found: DataFrame, few: bool) -> DataFrame:
    """Pages with the template of their host."""
    same = F.col("host").eqNullSafe(F.col("host_of"))
    if few:
        return rows.join(F.broadcast(found), same, "left")
    salted = found.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    page = rows.withColumn("salt", F.pmod("mark", F.lit(SALTS)).cast("int"))
    return page.join(salted, same & (F.col("salt") == F.col("salt_of")), "left")
