"""HTML extraction by a host's suffix array, with markup as a further signal.

A page is cut into blocks. Markup tells main text (an article or main element), shells (menus, footers, adverts
and the like), blocks that it leaves open, and parts of an article whose class only hints at a shell. What a site
repeats outside of its articles is boilerplate: the token streams of the shells, open and hinted blocks of all
pages are concatenated (each page keeps its own separator) and their suffixes are sorted, by prefix doubling, as
far as RUN tokens, so that neighbours with equal ranks are substrings of at least that length. Those found in
MIN_PAGES distinct contents of one host are boilerplate: the tokens of open and hinted blocks that they cover are
cut out, unique runs stay. Plain paragraphs of an article stay whole, also where articles share them: they are
its text. Copies of a page (equal in its main or its open text, whichever is longer) are one content.

Every task sorts the suffixes of its own pages and sends each distinct run with the contents that have it (of a
task's contents MIN_PAGES at most, which decide it); the runs are then counted by key with partial aggregation.
So no host has to fit into one task, and no run of enough pages is missed.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, Scratch, arrow_rows, frugal, mix64, new_vocab, odd_multipliers, word_hashes

#: Tokens of the shortest substring that counts as repeated, and distinct contents of a host that must have it.
RUN, MIN_PAGES = 8, 3

# Elements and class words by what they hold.
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
#: Elements without text of the page, which end with their parent where their own end tag is missing.
NO_TEXT = ("noscript", "template", "svg", "object", "select", "datalist", "optgroup", "option", "button", "canvas", "audio", "video")
SHELL = ("nav", "footer", "aside", "menu", "dialog", "head", "fieldset")
BLOCKS = ("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul").split()
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
SHELL_WORDS = ("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar footer site-footer header site-header masthead topbar cookie cookies consent gdpr notice notices notification alert disclaimer comment comments reply replies disqus respond newsletter subscribe subscription signup login share sharing social related recommended popup modal overlay widget pagination pager toolbar skip search "
    "ad-banner ad-box ad-container ad-slot ad-unit comment-body comment-list comments-area cookie-banner left-sidebar main-menu main-nav nav-menu related-posts right-sidebar search-form share-buttons sidebar-left sidebar-right site-nav skip-link social-share").split()
#: Of these, the words that tell a shell also as a part of a longer class or id; the others do so only as a whole.
PART_WORDS = "adv advert adverts advertisement advertising adsense sponsored navbar breadcrumb breadcrumbs masthead cookie cookies gdpr comments replies disqus newsletter pagination pager".split()
#: First parts of a class that speaks of another element ("has-sidebar").
MODIFIERS = ("has", "is", "no", "not", "with", "without")
#: Shells in which an article is a comment.
COMMENT_WORDS = "comment comments comment-body comment-list comments-area reply replies disqus respond".split()
#: Words of shells that inside main text may name a part of it (its heading, a section on related work): they only hint,
#: and so do there all words of an id, which is often made from a heading, and parts of a class.
HINTS = "header related social search skip".split()
SHELL_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form")
MAIN_WORDS = ("article article-body article-content post-content entry-content post-body content-body story-body main-content").split()

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_IN_BLOCKS, _IN_VOID, _IN_RAW, _IN_SHELL = frozenset(BLOCKS), frozenset(VOID), frozenset(RAW), frozenset(SHELL)
_SHELL_SET, _ROLE_SET, _MAIN_SET = frozenset(SHELL_WORDS), frozenset(SHELL_ROLES), frozenset(MAIN_WORDS)
_HINT_SET, _SHELL_IN_MAIN = frozenset(HINTS), _SHELL_SET - frozenset(HINTS)
_PART_SET, _COMMENT_SET, _IN_NO_TEXT = frozenset(PART_WORDS), frozenset(COMMENT_WORDS), frozenset(NO_TEXT)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
MAIN, OPEN, SHELL_BLOCK, HINTED = 0, 1, 2, 3
#: While parsing only: a shell in which an article is not main text, a form, an element without text.
_FIRM, _FORM, _NONE = 4, 5, 6


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), entities.unescape(value.strip("\"'")) if value else "")
    return out


def _kind(tag: str, source: str, in_main: bool) -> int | None:
    """What an element makes of its content: main text, a shell, or (None) what it is in."""
    if tag in _IN_SHELL:
        return _FIRM
    if tag == "header" and not in_main:
        return SHELL_BLOCK
    if tag == "form":
        return SHELL_BLOCK if in_main else _FORM
    found = None
    if tag in ("article", "main"):
        found = MAIN
    if source and not source.isspace():
        at = _attributes(source)
        classes, ids = set(at.get("class", "").lower().split()), set(at.get("id", "").lower().split())
        words = classes | ids
        parts = {p for w in words for p in re.split(r"[-_]+", w) if re.split(r"[-_]+", w)[0] not in MODIFIERS}
        if "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", "")):
            return _FIRM
        if in_main and tag in _HEADINGS:  # named by their words, and so are their ids
            return found
        if tag != "body" and tag != "html" and tag != "main" and (words & _COMMENT_SET or not in_main and "comments" in parts):
            return _FIRM
        shell = classes & _SHELL_IN_MAIN if in_main else words & _SHELL_SET or parts & _PART_SET
        if at.get("role", "").lower() in _ROLE_SET or (tag not in ("body", "html", "article", "main") and shell):
            return SHELL_BLOCK
        if at.get("role", "").lower() == "main" or words & _MAIN_SET:
            found = MAIN
        elif in_main and tag not in ("article", "main") and (words & _HINT_SET or ids & _SHELL_SET or parts & _PART_SET):
            found = HINTED
    return found


def _within(kind: int, own: int | None, tag: str) -> int:
    """The kind of an element's content, from the kind it is in and what it makes of it."""
    if own is None or kind == _NONE:
        return kind
    if own == MAIN:
        return kind if kind == _FIRM and tag != "main" else MAIN
    if own == _FORM:
        return _FORM if kind == OPEN else kind
    if own == HINTED:
        return HINTED if kind == MAIN else kind
    return _FIRM if kind == _FIRM else own


def page_blocks(source: str | None) -> list[tuple[int, str]]:
    """A page's blocks in order: (kind, text) with references decoded and white space as one blank.

    Reader comments are shells also within an article. What stands within a shell is a shell, but a main
    element is main text in any shell, and an article in those that a class or a form makes. A form that
    holds most of the page's text is open, and so are the shells of a page that has nothing else.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open block elements and the kind they set
    opened: dict[str, int] = {}  # how many of each tag are on the stack
    kind = OPEN
    pieces: list[str] = []
    raw: str | None = None
    unended: set[str] = set()

    def close() -> None:
        if pieces:
            text = _BLANK.sub(" ", entities.unescape("".join(pieces))).strip(" ")
            pieces.clear()
            if text and kind != _NONE:
                out.append((kind, text))

    def enter(tag: str) -> None:
        stack.append((tag, kind))
        opened[tag] = opened.get(tag, 0) + 1

    def pop() -> str:
        nonlocal kind
        tag, kind = stack.pop()
        opened[tag] -= 1
        return tag

    def leave(tag: str) -> None:
        if opened.get(tag):
            close()
            while pop() != tag:
                pass

    pos, end = 0, len(source or "")
    while pos < end:
        if raw is not None:  # content that is no markup, up to its end tag
            m = None if raw in unended else re.compile(r"</" + re.escape(raw) + r"(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, pos)
            if m:
                pos = m.end()
            else:  # its parent's end tag ends it too
                unended.add(raw)
                m = re.compile(r"</" + re.escape(stack[-1][0] if stack else "body") + r"(?=[\s/>]|\Z)", re.I).search(source, pos)
                pos = m.start() if m else end
            raw = None
            continue
        m = _TOKEN.match(source, pos)
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            if source[m.start()] != "<" or m.end() - m.start() == 1:
                pieces.append(m[0])
            continue
        tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if tag in _IN_RAW:
            if not closing and not attributes.endswith("/"):
                raw = tag
            continue
        if tag in _IN_NO_TEXT:
            if closing:
                leave(tag)
            elif not attributes.endswith("/"):
                if tag in ("option", "button"):  # a further one ends the one before
                    if stack and stack[-1][0] == tag:
                        leave(tag)
                close()
                enter(tag)
                kind = _NONE
            continue
        if tag == "br" or tag == "img" or tag == "wbr":
            pieces.append(" ")
            continue
        if tag not in _IN_BLOCKS:
            if not closing and tag not in _IN_VOID and attributes and kind in (MAIN, OPEN, HINTED, _FORM) and (own := _kind(tag, attributes, kind in (MAIN, HINTED))) in (SHELL_BLOCK, _FIRM):
                close()
                enter(tag)
                kind = own
            elif closing:
                leave(tag)
            continue
        close()
        if closing:
            leave(tag)
            continue
        if tag in _IN_VOID:
            continue
        while stack and stack[-1][0] == "p":  # a block ends an open paragraph
            pop()
        if tag in ("li", "dd", "dt", "tr", "td", "th"):
            same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}[tag]
            while stack and stack[-1][0] in same:
                pop()
        own = _kind(tag, attributes, kind in (MAIN, HINTED))
        enter(tag)
        kind = _within(kind, own, tag)
    close()
    sizes = [0] * 7
    for k, text in out:
        sizes[k] += len(text)
    form = OPEN if sizes[_FORM] > sizes[MAIN] + sizes[OPEN] else SHELL_BLOCK
    shell = SHELL_BLOCK if sizes[MAIN] or sizes[OPEN] or form == OPEN else OPEN
    as_what = {MAIN: MAIN, OPEN: OPEN, HINTED: HINTED, SHELL_BLOCK: shell, _FIRM: shell, _FORM: form}
    return [(as_what[k], text) for k, text in out]


def _host(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def _content(blocks: list[tuple[int, str]]) -> int:
    """Digest of a page's main or open text, whichever is longer: equal for copies of a page."""
    texts = [" ".join(" ".join(t for k, t in blocks if k == kind).lower().split()) for kind in (MAIN, OPEN)]
    return xxhash.xxh64_intdigest(max(texts, key=len)) - (1 << 63)


def _ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``length`` tokens, by prefix doubling."""
    def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        after = np.full(len(a), -1, np.int64)
        after[: max(0, len(a) - shift)] = b[shift:]
        pairs = a.astype(np.int64) * (int(b.max(initial=0)) + 2) + after + 1
        return np.unique(pairs, return_inverse=True)[1]

    have, ranks = 1, tokens
    while have < length:
        step = min(have, length - have)
        ranks = joined(ranks, ranks, step)
        have += step
    return ranks


class _Streams:
    """The concatenated token streams of some pages, each token with its page; separators are unique.

    ``kinds``: whose blocks the streams have. A page's place counts its tokens of these blocks.
    """

    def __init__(self, batch, kinds: tuple[int, ...]):
        vocab = new_vocab()
        parts, owners, hosts = [], [], []
        for k, (url, blocks, of) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("url", "blocks", "kinds")))):
            words = [w for block, kind in zip(blocks, of) if kind in kinds for w in block.lower().split()]
            parts.append(np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)))
            owners.append(np.full(len(words) + 1, k))
            hosts.append(_host(url).encode())
        self.hashes, self.hosts = word_hashes(w.encode() for w in vocab), word_hashes(hosts)
        separators = len(vocab) + np.arange(len(parts))
        self.tokens = np.concatenate([np.append(p, s) for p, s in zip(parts, separators)]) if parts else np.zeros(0, np.int64)
        self.owner = np.concatenate(owners) if owners else self.tokens
        self.first = np.searchsorted(self.owner, np.arange(len(parts)))
        n = len(self.tokens) - RUN + 1
        self.places = np.zeros(0, np.int64)
        if n > 0:  # a window that ends on its page's separator is no run
            same = np.flatnonzero(self.owner[:n] == self.owner[RUN - 1 :])
            self.places = same[self.tokens[same + RUN - 1] < len(vocab)]

    def keys(self, places: np.ndarray) -> np.ndarray:
        """Digests of host and run at each place."""
        total = mix64(self.hosts[self.owner[places]])
        for i, m in enumerate(odd_multipliers(RUN, 41)):
            total = total + mix64(self.hashes * m)[self.tokens[places + i]]
        return mix64(total).view(np.int64)

    def runs(self, contents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct run of a host, from the sorted suffixes, with the contents that have it (MIN_PAGES at most)."""
        if not len(self.places):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        host = np.unique(self.hosts, return_inverse=True)[1][self.owner[self.places]]
        of = np.unique(contents, return_inverse=True)[1][self.owner[self.places]]
        runs = _ranks(self.tokens, RUN)[self.places] * (int(host.max()) + 1) + host
        order = np.lexsort((of, runs))
        runs, of, places = runs[order], of[order], self.places[order]
        new_run = np.append(True, runs[1:] != runs[:-1])
        new = np.flatnonzero(new_run | np.append(True, of[1:] != of[:-1]))
        run = np.cumsum(new_run)[new]  # a run's contents stand together
        nth = np.arange(len(new)) - np.searchsorted(run, run)
        new = new[nth < MIN_PAGES]
        return self.keys(places[new]), contents[self.owner[places[new]]]


def _read(batches):
    """Each page's blocks, their kinds, and the digest of its content."""
    task = TaskContext.get()
    uid = (task.partitionId() if task else 0) << 36
    for batch in batches:
        pages = [page_blocks(source) for source in batch.column("html").to_pylist()]
        n = len(pages)
        arrays = [pa.array(range(uid, uid + n), pa.int64()), batch.column("page_id"), batch.column("url"), pa.array([[t for _, t in p] for p in pages], pa.list_(pa.string())),
                  pa.array([[k for k, _ in p] for p in pages], pa.list_(pa.int32())), pa.array([_content(p) for p in pages], pa.int64())]
        uid += n
        yield pa.RecordBatch.from_arrays(arrays, ["uid", "page_id", "url", "blocks", "kinds", "content"])


def _runs(batches):
    """The runs of all blocks but an article's plain ones, with the contents that have them."""
    for batch in batches:
        keys, contents = _Streams(batch, (OPEN, SHELL_BLOCK, HINTED)).runs(batch.column("content").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contents, pa.int64())], ["key", "content"])


def _places(may_hold):
    """The places of open and hinted tokens at which a repeated run may begin."""
    def places(batches):
        for batch in batches:
            stream = _Streams(batch, (OPEN, HINTED))
            keys = stream.keys(stream.places)
            found = np.flatnonzero(may_hold(keys))
            place = stream.places[found]
            page = stream.owner[place]
            uid = batch.column("uid").to_numpy()[page]
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(keys[found], pa.int64()), pa.array(place - stream.first[page], pa.int32())], ["uid", "key", "place"])

    return places


def _without(block: str, hit: np.ndarray) -> str:
    """A block without the tokens that are hit; what is left stays as it is, with a blank at each cut."""
    spans = [m.span() for m in re.finditer(r"\S+", block)]
    left, last = [], None
    for k in np.flatnonzero(~hit):
        if left:
            left.append(block[spans[last][1] : spans[k][0]] if last == k - 1 else " ")
        left.append(block[spans[k][0] : spans[k][1]])
        last = k
    return "".join(left)


def _cut(batches):
    """The text of each page: its blocks but shells, without the tokens that repeated runs cover."""
    for batch in batches:
        texts = []
        for blocks, kinds, covered in zip(*(batch.column(c).to_pylist() for c in ("blocks", "kinds", "covered"))):
            shown = [k for k in kinds if k != SHELL_BLOCK]
            blocks = [b for b, k in zip(blocks, kinds) if k != SHELL_BLOCK]
            if covered:
                sizes = [len(b.lower().split()) if k != MAIN else 0 for b, k in zip(blocks, shown)]
                hit = np.zeros(sum(sizes), bool)
                for i in range(RUN):
                    hit[np.array(covered) + i] = True
                ends = np.cumsum(sizes)
                blocks = [_without(b, hit[end - n : end]) if hit[end - n : end].any() else b for b, n, end in zip(blocks, sizes, ends)]
            texts.append("\n".join(b for b in blocks if b))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages`` (page_id, url, html).

    Null and empty pages have an empty text; a table without rows gives none. Repeated rows and other copies of a
    page count as one content, and each has its text. A page without a url has the empty host. Texts of any length
    are read in one pass. Other columns of ``pages``, of any name, are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    with arrow_rows(spark):
        read = scratch.table(pages.mapInArrow(frugal(_read), "uid long, page_id long, url string, blocks array<string>, kinds array<int>, content long"))
        runs = read.select("url", "blocks", "kinds", "content").mapInArrow(frugal(_runs), "key long, content long")
        repeated = scratch.table(runs.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES).select("key"))
        often = Bitmap(repeated, "key")
        places = read.select("uid", "url", "blocks", "kinds").mapInArrow(frugal(_places(often.test())), "uid long, key long, place int")
        covered = scratch.table(places.join(repeated, "key", "left_semi").groupBy("uid").agg(F.collect_set("place").alias("covered")))
        often.drop()
    # Only pages that have a cut are sent to meet it.
    touched = Bitmap(covered.select(F.xxhash64("uid").alias("key")), "key").may_hold(F.xxhash64("uid"))
    read = read.withColumn("_touched", touched)
    text = "page_id long, url string, text string"
    whole = read.where(~F.col("_touched")).select("page_id", "url", "blocks", "kinds", F.lit(None).cast("array<int>").alias("covered"))
    cut = read.where("_touched").join(covered, "uid", "left").select("page_id", "url", "blocks", "kinds", "covered")
    return whole.mapInArrow(frugal(_cut), text).union(cut.mapInArrow(frugal(_cut), text))


def query(spark, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
