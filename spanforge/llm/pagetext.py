"""Main text of web pages, without what a site repeats.

Every page is parsed once. Each element subtree gets a hash of its tags and text (white space collapsed, no attributes).
Spark counts, for each host, the pages of different content that hold a subtree, and subtrees that recur are deleted,
whatever their tags: that is how a site's menus, notices and footers are found. Menus, headers, footers, sidebars, forms,
adverts, notices and reader comments that say so by tag, role, class or id are left out on any page.

What an article says can recur too (copies of a text, quoted passages), so prose is sheltered: blocks of an article whose text is
mostly outside links, and whatever encloses them, are never deleted as a template. Pages whose main text is sheltered
throughout are finished where they were parsed; only for the others is the page joined with the recurring subtrees of its host.

Main text: the outermost article elements, or else main elements, or else the body. Blocks are the texts between the
borders of block elements; a line break inside a block is white space.

Defined cases: null or empty html: empty text. Null url, or one without a host: a host of its own. Repeated pages: each
has its row, and pages of equal content count once for a template. Text without tags: one block. Broken markup (open
tags, stray end tags, lone ampersands, an open comment, which swallows the rest) as browsers read it, in rough. Empty
table: empty result. Input columns named like an output are replaced, other columns stay.

Scale: one pass over the html, which is never shuffled. What is written for the join are blocks of text and 8-byte
hashes; a template of a hot host is counted with map-side aggregation over (host, subtree, content).
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import common

#: A subtree is a template from so many different pages of its host on, and from this share of them on.
MIN_PAGES, MIN_SHARE = 5, 0.01
OUTPUTS = ("text", "n_chars")
SALTS = 16

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input map math menu nav noembed noframes noscript object option script search "
    "select style svg template textarea title video xmp".split()
)
#: Words of role, class and id that name what is no part of the main text.
NAMED = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial alert aside banner breadcrumb breadcrumbs comment comments commentlist complementary "
    "consent contentinfo cookie cookies copyright discussion disqus feedback footer form gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promoted promotion recommendations recommended related replies reply respond responses search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget widgets".split()
)
#: Of these, an article element can carry only the ones that make it another text than the page's own.
NAMED_ARTICLE = frozenset("ad ads advert advertisement comment promo promoted recommended related reply sponsored teaser".split())
NEGATED = frozenset("has no not with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

#: Open elements of these tags end where one of those tags begins; never beyond the third set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}

TOKEN = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>?))")
COMMENT_NONE, COMMENT_END = re.compile(r"-?>"), re.compile(r"--!?>")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HEADER = re.compile(r"\b(?:class|id)\s*=\s*[\"']?(?:[^\"'>]*[\s_-])?header(?=[\s\"'>]|$)", re.I)
HIDDEN = re.compile(r"\shidden(?=[\s=/>])", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _named(attributes: str, words: frozenset) -> bool:
    """Whether role, class or id hold one of the words, not negated as in no-sidebar."""
    for m in NAMES.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            found = [w.lower() for w in WORD.findall(name)]
            if any(w in words and not (i and found[i - 1] in NEGATED) for i, w in enumerate(found)):
                return True
    return False


class Element:
    __slots__ = ("tag", "out", "kind", "parts", "text", "linked", "shelter", "number")

    def __init__(self, tag, out, kind, number):
        self.tag, self.out, self.kind, self.number = tag, out, kind, number
        self.parts, self.text, self.linked, self.shelter = [], 0, 0, False


class Page:
    """One pass over a page: its text blocks with their enclosing elements, and the hash of every block element."""

    def __init__(self, html: str):
        self.stack = [Element("", False, 0, 0)]
        self.pieces, self.blocks, self.hashes, self.sheltered = [], [], [0], [False]
        self.links = self.best = 0
        at, n = 0, len(html)
        while at < n:
            m = TOKEN.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            self._text(html[at : m.start()])
            at = m.end()
            if m[1]:
                at = m.start() + 4
                end = COMMENT_NONE.match(html, at) or COMMENT_END.search(html, at)
                at = end.end() if end else n
            elif m[2]:
                if html.startswith("![CDATA[", m.start() + 1):
                    end = html.find("]]>", at)
                    at = n if end < 0 else end + 3
                else:
                    end = html.find(">", at)
                    at = n if end < 0 else end + 1
            elif not m[5].endswith(">"):
                break  # the page ends inside a tag
            elif m[3]:
                self._end(m[4].lower())
            else:
                tag = m[4].lower()
                self._start(tag, m[5])
                if tag in RAW:
                    end = RAW_END[tag].search(html, at)
                    at = end.start() if end else n
                    self.stack[-1].parts.append(html[m.end() : at])
        self._close(1)
        self._border()

    def _text(self, raw: str) -> None:
        if raw:
            top = self.stack[-1]
            said = unescape(raw)
            if not top.out:
                self.pieces.append(said)
            size = len(said) - said.count(" ")
            top.text += size
            if self.links:
                top.linked += size
            top.parts.append(" ".join(said.split()))

    def _border(self) -> None:
        """A block ends here: it belongs to the elements that are open."""
        if self.pieces:
            said = " ".join("".join(self.pieces).split())
            self.pieces = []
            if said:
                top = self.stack[-1]
                self.blocks.append((said, top.kind, [e.number for e in self.stack if e.number]))

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
        if tag in BLOCKS:
            self._border()
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == "p":
                    self._close(i)
                elif self.stack[i].tag in BLOCKS:
                    break
        if tag in CLOSES:
            ends, beyond = CLOSES[tag]
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in beyond:
                    break
                if self.stack[i].tag in ends:
                    self._close(i)
        if tag in VOID or attributes.endswith("/>") and tag not in BLOCKS and tag not in RAW and tag not in ("a", "b", "i", "span"):
            return
        top = self.stack[-1]
        out, kind = top.out or tag in DROPPED, top.kind
        if not out and tag not in ("html", "body"):
            out = _named(attributes, NAMED_ARTICLE if tag in ("article", "main") else NAMED) or bool(HIDDEN.search(attributes))
        if not out and (tag == "header" or tag in BLOCKS and HEADER.search(attributes)):
            out, kind = kind == 0, -kind if kind > 0 else kind  # in an article, its headings stay
        elif kind < 0 and tag in HEADINGS:
            kind = -kind
        if tag in ("article", "main") and not out:
            kind = 2 if tag == "article" else max(kind, 1)
            self.best = max(self.best, kind)
        number = 0
        if tag in BLOCKS and tag not in ("html", "body", "article", "main"):
            number = len(self.hashes)
            self.hashes.append(0)
            self.sheltered.append(False)
        self.links += tag == "a"
        self.stack.append(Element(tag, out, kind, number))

    def _end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                if tag in BLOCKS:
                    self._border()
                self._close(i)
                return
            if tag not in BLOCKS and self.stack[i].tag in BLOCKS:
                return  # an inline end tag doesn't reach beyond its block

    def _close(self, i: int) -> None:
        """Close element i of the stack and what is open in it."""
        while len(self.stack) > i:
            if self.stack[-1].tag in BLOCKS:
                self._border()
            e = self.stack.pop()
            self.links -= e.tag == "a"
            if e.kind and not e.out and e.tag in PROSE and e.linked * 2 < e.text:
                e.shelter = True
            mark = blake2b("\x00".join((e.tag, *(p for p in e.parts if p))).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            if e.number:
                self.hashes[e.number] = int.from_bytes(mark, "big", signed=True)
                self.sheltered[e.number] = e.shelter
            up = self.stack[-1]
            up.parts.append(mark.hex())
            up.text += e.text
            up.linked += e.linked
            up.shelter |= e.shelter

    def main(self) -> list[tuple[str, list[int]]]:
        """(text, hashes of the subtrees that could be a template) of each block of the main text."""
        return [(text, [self.hashes[i] for i in inside if not self.sheltered[i]]) for text, kind, inside in self.blocks if kind == self.best]

    def candidates(self) -> list[int]:
        return list({h for h, s in zip(self.hashes[1:], self.sheltered[1:]) if not s})


def _content(blocks: list) -> int:
    return int.from_bytes(blake2b("\n".join(t for t, _ in blocks).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def parsed(pages: DataFrame) -> DataFrame:
    """pages (html, host, ...) without html, with blocks (text, marks), content and subtrees."""
    import pyarrow as pa

    kinds = {
        "blocks": pa.list_(pa.struct([("text", pa.string()), ("marks", pa.list_(pa.int64()))])),
        "content": pa.int64(), "subtrees": pa.list_(pa.int64()),
    }

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("__html")
            for part in common.slices(batch, "__html"):
                made = []
                for html in part.column(at).to_pylist():
                    page = Page(html or "")
                    blocks = page.main()
                    made.append(([{"text": t, "marks": m} for t, m in blocks], _content(blocks), page.candidates()))
                rest = [(c, f) for i, (c, f) in enumerate(zip(part.columns, part.schema)) if i != at]
                new = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([c for c, _ in rest] + new, names=[f.name for _, f in rest] + [f"__{k}" for k in kinds])

    rest = common.without(pages, "__html")
    schema = common.add_columns(rest.schema, __blocks="array<struct<text:string,marks:array<bigint>>>", __content="long", __subtrees="array<bigint>")
    return common.mapped(pages, run, schema)


def templates(seen: DataFrame, pages: int = MIN_PAGES, share: float = MIN_SHARE) -> DataFrame:
    """(host, subtree) that recur; seen: __host, __content, __subtrees of every page."""
    each = seen.select("__host", "__content", F.explode("__subtrees").alias("__subtree")).distinct()
    whole = seen.select("__host", "__content").distinct().groupBy("__host").agg(F.count("*").alias("of"))
    often = each.groupBy("__host", "__subtree").agg(F.count("*").alias("n")).where(F.col("n") >= pages)
    return often.join(whole, "__host").where(F.col("n") >= share * F.col("of")).select("__host", "__subtree")


def _salted(df: DataFrame) -> DataFrame:
    """Every row once for each salt, so that a hot key of the other side of a join is met by SALTS tasks."""
    return df.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = MIN_SHARE) -> DataFrame:
    """pages (url, html, ...) with text and n_chars instead of html."""
    names = [c for c in pages.columns if c.lower() not in OUTPUTS]
    safe = {c: f"__c{i}" for i, c in enumerate(names) if c != "html"}
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    flat = pages.select(*[common.named(c).alias(n) for c, n in safe.items()], host.alias("__host"), F.col("html").alias("__html"))
    work = common.Scratch(pages.sparkSession, "pagetext")
    # the digest names a page for the join; rows that share it have the same blocks on the same host
    rows = work.stored(parsed(flat).withColumn("__open", F.exists("__blocks", lambda b: F.size(b["marks"]) > 0)), "parsed", texts=True)
    found = templates(rows.select("__host", "__content", "__subtrees"), min_pages, share)
    own = F.array_distinct(F.flatten(F.transform("__blocks", lambda b: b["marks"])))
    asked = rows.where("__open").select("__host", "__content", F.explode(own).alias("__subtree")).distinct()
    gone = (
        asked.withColumn("__salt", F.pmod("__content", F.lit(SALTS))).join(_salted(found), ["__host", "__subtree", "__salt"])
        .groupBy("__host", "__content").agg(F.collect_set("__subtree").alias("__gone"))
    )
    spread = F.pmod(F.xxhash64(F.lit(0), *safe.values()), F.lit(SALTS))
    opened = rows.where("__open").withColumn("__salt", spread).join(_salted(gone), ["__host", "__content", "__salt"], "left").drop("__salt")
    stays = F.filter("__blocks", lambda b: F.col("__gone").isNull() | ~F.arrays_overlap(b["marks"], F.col("__gone")))
    both = rows.where("not __open").withColumn("__kept", F.col("__blocks")).unionByName(opened.withColumn("__kept", stays).drop("__gone"))
    text = F.array_join(F.transform("__kept", lambda b: b["text"]), "\n\n")
    done = both.withColumn("__text", text)
    return done.select(*[F.col(n).alias(c) for c, n in safe.items()], F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: For the markup of the tables: one article, blocks of h1 and p, two references. The parser is held against more in the tests.
ORACLE = """
with a as (
  select page_id, url, regexp_replace(coalesce(html, ''), '<(script|style)>.*?</(script|style)>', '', 'gs') as h from pages),
b as (
  select page_id, url, row_number() over () as r, regexp_split_to_array(regexp_replace(regexp_extract(h, '<article>(.*?)</article>', 1, 's'), '<br>', ' ', 'g'), '</?(?:p|h1)>') as b from a),
c as (
  select r, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b[i], '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) as t
  from b, unnest(range(1, len(b.b) + 1)) as u(i)),
d as (select r, string_agg(t, chr(10) || chr(10) order by i) as t from c where t <> '' group by r)
select page_id, url, coalesce(t, '') as text, length(coalesce(t, ''))::bigint as n_chars from b left join d using (r)
"""
