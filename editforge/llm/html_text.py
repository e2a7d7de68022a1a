"""Operator 2: main text of web pages by line-block distribution.

Markup is stripped into lines, one a block element. A line's weight is its
text outside links; page furniture (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments) goes with the markup. Weights are
summed over a sliding window of lines; a span surges where the sum passes a
threshold and dives where it falls to nothing. The spans kept are those that
hold the page's text; inside an article element text weighs more. A container
that the spans hold most of is whole: lines between its first and last kept
one stay, as do its headings before and paragraphs around them. Where names
of furniture leave little of a page, names around most of its text are not
believed, and then none is; inside an article, a name that may as well be the
topic's counts only if links or short lines agree. Work is linear in a page.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is never text.
UNSEEN = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "object", "iframe", "canvas", "audio", "video",
          "map", "select", "datalist", "textarea", "button"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
#: Elements of page furniture.
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
#: Words in class, id or role that mark page furniture.
HINTS = {"nav", "navbar", "navigation", "menu", "menubar", "header", "masthead", "topbar", "footer", "sidebar", "side", "aside", "ad", "ads",
         "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "promo", "promotion", "sponsor", "sponsored",
         "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "warning", "disclaimer", "newsletter",
         "subscribe", "subscription", "signup", "login", "signin", "register", "comment", "comments", "commentlist", "reply", "replies",
         "respond", "disqus", "share", "sharing", "social", "related", "recommended", "recommendations", "breadcrumb", "breadcrumbs",
         "pagination", "pager", "toolbar", "widget", "widgets", "popup", "modal", "overlay", "search", "form", "copyright", "legal",
         "skip", "hidden", "contentinfo", "complementary", "dialog", "toc", "tags", "byline", "outbrain", "taboola"}
#: Of these, words that name parts of an article as well, and words that do so in a compound ("notice-board").
DOUBTFUL = {"byline", "form", "legal", "register", "related", "search", "share", "side", "skip", "social", "tags", "toc", "copyright", "overlay"}
WHOLE = {"alert", "disclaimer", "header", "notice", "notices", "notification", "recommended", "replies", "reply", "respond", "warning"}
#: Elements that begin and end a line.
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li",
          "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements whose text is one whole, and elements of running text in it.
BOXES = {"article", "body", "center", "div", "dl", "fieldset", "figure", "form", "main", "menu", "ol", "section", "table", "td", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
RUNNING = HEADINGS | {"blockquote", "p", "pre"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words in class, id, role or itemprop that mark the article.
ARTICLE = {"article", "articlebody", "main", "post", "story", "entry"}

#: Weight of text inside an article element.
ARTICLE_WEIGHT = 5

OPENING = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)(?=[a-zA-Z])", re.S)
TAG = re.compile(r"([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
MARKS = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def hints(attributes: str) -> tuple[int, bool, bool, bool]:
    """What class, id, role, itemprop say: page furniture (2, doubtful inside an article: 1), article, hidden, content."""
    furniture, article, hidden, content = 0, False, False, False
    for name, value in MARKS.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" and not value or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif name in ("class", "id", "role", "itemprop"):
            for token in value.split():
                parts = [p.lower() for p in PARTS.findall(token)]
                marks = HINTS.intersection(parts)
                wrapped = ARTICLE.intersection(parts) or token.lower() in ARTICLE
                # "post-header", "entry-title": parts of an article; "comments-main": furniture.
                if marks and not (wrapped and marks <= {"header"}):
                    doubtful = marks <= (DOUBTFUL | WHOLE if len(parts) > 1 else DOUBTFUL)
                    furniture = max(furniture, 1 if doubtful else 2)
                elif wrapped and len(parts) == 1 or "".join(parts) in ("articlebody", "maincontent", "postcontent", "entrycontent", "articlecontent"):
                    article = True
                elif parts == ["content"]:
                    content = True
    return furniture, article, hidden, content


def tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of quotes and ``>``, and for each where a tag whose attributes go on there ends (-1: nowhere)."""
    at = [m.start() for m in re.finditer("[\"'>]", page)]
    ends, after = [-1] * (len(at) + 1), {"'": len(at), '"': len(at)}
    for k in range(len(at) - 1, -1, -1):
        c = page[at[k]]
        if c == ">":
            ends[k] = at[k]
        else:
            ends[k] = ends[min(after[c] + 1, len(at))]
            after[c] = k
    return at, ends


def tags(page: str):
    """(start, end, slash, name, attributes) of each tag; comments, declarations and CDATA have no name. A ``<`` without an end is text."""
    seek, ends = 0, None
    while m := OPENING.search(page, seek):
        if m.group(1) is None:
            seek = m.end()
            yield m.start(), seek, "", None, ""
            continue
        if ends is None:
            t = TAG.match(page, m.end())
            if t:
                seek = t.end()
                yield m.start(), seek, m.group(1), t.group(1).lower(), t.group(2)
                continue
            ends = tag_ends(page)  # from here on ends are looked up, so that no quote is followed twice
        end = ends[1][bisect_left(ends[0], m.end())]
        if end < 0:
            seek = m.end()
            continue
        name = NAME.match(page, m.end(), end)
        seek = end + 1
        yield m.start(), seek, m.group(1), name.group().lower(), page[name.end(): end]


def lines(page: str) -> tuple[list[tuple[str, int, int, bool, int, str]], list[tuple[int, int, bool]]]:
    """Lines of a page: (text, length outside links, number of the innermost element of furniture, inside an article element,
    number of the innermost box, innermost block).

    The second list tells of each element of furniture (0: none) the number of the one
    around it, what makes it one (0: itself, 1: a doubtful name, 2: a name), and
    whether names alone make it and all around it furniture.
    """
    out, text = [], []
    marks = [(0, 0, True)]
    outside = (0, False, False, 0, "body")
    open_tags, counts, blocks = [], Counter(), []  # (name, furniture, article, content, box, block from here on); open names; depths of open blocks
    linked = links = boxes = 0
    furniture, article, content, box, block = outside
    unclosed = set()

    def flush():
        nonlocal text, linked
        s = " ".join(entities.unescape("".join(text)).split())
        if s:
            out.append((s, max(0, len(s) - linked), furniture, article, box, block))
        text, linked = [], 0

    def close(depth):
        nonlocal furniture, article, content, box, block
        while len(open_tags) > depth:
            counts[open_tags.pop()[0]] -= 1
        while blocks and blocks[-1] >= depth:
            blocks.pop()
        furniture, article, content, box, block = open_tags[-1][1:] if open_tags else outside

    def read(piece):
        nonlocal linked
        if piece:
            text.append(piece)
            if links:
                linked += len(" ".join(entities.unescape(piece).split()))

    at = 0
    for start, stop, slash, name, attributes in tags(page):
        if start < at:  # inside an element whose content is not read
            continue
        read(page[at:start])
        at = stop
        if name is None:
            if page.startswith("<![CDATA[", start):
                text.append(entities.escape(page[start + 9: at].removesuffix("]]>")))
            continue
        if slash:
            if name in BLOCKS:
                flush()
            if name == "a":
                links = max(0, links - 1)
            if counts[name]:
                depth = len(open_tags) - 1
                while open_tags[depth][0] != name:
                    depth -= 1
                close(depth)
            elif name == "p":
                flush()
            continue
        if name in UNSEEN:
            if attributes.endswith("/"):
                continue
            end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>" + (r"|<body\b" if name == "head" else ""), re.I).search(page, at)
            if end is None:
                unclosed.add(name)
                if name not in RAW:
                    continue  # never closed: its start tag alone goes
            text.append(" ")
            at = len(page) if end is None else (end.start() if end.group().lower().startswith("<body") else end.end())
            continue
        if name in BLOCKS:
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "a":
            links += 1
        if name not in BLOCKS and name not in FURNITURE and not MARKS.search(attributes):
            continue
        if name == "p" and blocks and open_tags[blocks[-1]][0] == "p":  # a paragraph ends where the next begins
            close(blocks[-1])
        marked, body, hidden, holds = hints(attributes) if name not in ("html", "body") else (0, False, False, False)
        if not (article or content):
            marked = 2 if marked else 0
        begins = name in ("article", "main") or body and not marked
        if not hidden and (name == "main" or name == "article" and not marked) and marks[furniture][2]:
            furniture = 0  # what names around it say is about the page, not about its text
        fixed = hidden or name in FURNITURE and name != "form" or name == "header" and not article
        if fixed or name == "form" or marked and name not in ("article", "main"):
            cause = 0 if fixed else 2 if name == "form" else marked
            marks.append((furniture, cause, cause > 0 and marks[furniture][2]))
            furniture = len(marks) - 1
        article = (article or begins) and not (furniture and not article)
        content = content or holds
        if name in BOXES:
            boxes += 1
            box = boxes
        if name in BLOCKS:
            block = name
            blocks.append(len(open_tags))
        open_tags.append((name, furniture, article, content, box, block))
        counts[name] += 1
    read(page[at:])
    flush()
    return out, marks


def spans(weight: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """Spans of lines from a surge point to the dive point after it."""
    n = len(weight)
    block = [sum(weight[i: i + window]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if block[i] > surge and weight[i]:  # surge point
            j = i
            while j < n and (weight[j] or block[j] > surge):  # dive point: nothing is left ahead
                j += 1
            while j > i and not weight[j - 1]:
                j -= 1
            out.append((i, j))
            i = max(j, i + 1)
        else:
            i += 1
    return out


def kept(found: list[tuple[str, int, bool, bool, int, str]], window: int, surge: int) -> list[int]:
    """Numbers of the lines (text, weight, furniture, inside an article element, box, block) that are main text."""
    article = [len(r[0]) if r[3] and not r[2] else 0 for r in found]
    whole = sum(article) * ARTICLE_WEIGHT
    # Furniture is stripped like markup, so that it does not part what stands around it.
    clear = [k for k, r in enumerate(found) if not r[2]]
    weight = [0 if article[k] else found[k][1] for k in clear]
    others = [(sum(weight[a:b]), a, b) for a, b in spans(weight, window, surge)]
    most = max([whole, *(w for w, _, _ in others)])
    if not most:  # a page of little text: what is not furniture
        return [k for k in clear if found[k][1]]
    out = {k for k, w in enumerate(article) if w} if whole * 5 >= most else set()
    out.update(clear[i] for w, a, b in others if w * 5 >= most for i in range(a, b) if weight[i])
    return filled(found, clear, out)


def filled(found, clear: list[int], out: set[int]) -> list[int]:
    """``out`` and what belongs to it in boxes that it holds most of: lines between, headings before, paragraphs around."""
    held, had, edges = Counter(), Counter(), {}
    for k in clear:
        box = found[k][4]
        had[box] += found[k][1]
        if k in out:
            held[box] += found[k][1]
            edges[box] = (edges.get(box, (k, k))[0], k)
    outer = dict(edges)
    for k in clear:
        _, w, _, _, box, block = found[k]
        if box in edges and k not in out and block in RUNNING and (w * 2 > len(found[k][0]) or k < edges[box][0] and block in HEADINGS):
            outer[box] = (min(outer[box][0], k), max(outer[box][1], k))
    return [k for k in clear if k in out or found[k][4] in outer and held[found[k][4]] * 2 > had[found[k][4]]
            and outer[found[k][4]][0] <= k <= outer[found[k][4]][1]]


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    """The main text of one page: the kept lines, joined by a blank."""
    if not page:
        return ""
    found, marks = lines(page)
    held, shown, longest = [0] * len(marks), [0] * len(marks), [0] * len(marks)  # text outside links, all text, longest line outside links in each element of furniture
    for s, w, f, *_ in found:
        held[f] += w
        shown[f] += len(s)
        longest[f] = max(longest[f], w)
    for f in range(len(marks) - 1, 0, -1):
        up = marks[f][0]
        held[up] += held[f]
        shown[up] += shown[f]
        longest[up] = max(longest[up], longest[f])
    fixed, doubted = [False] * len(marks), [False] * len(marks)
    for f in range(1, len(marks)):
        up, cause, _ = marks[f]
        fixed[f] = fixed[up] or not cause
        doubted[f] = cause == 1 and longest[f] >= surge and held[f] * 2 > shown[f]
    whole = sum(r[1] for r in found if not fixed[r[2]])
    believed = (lambda f: True, lambda f: held[f] * 2 < held[0], lambda f: False)  # all names, none around most of the text, no names
    for names in believed:
        furniture = [False] * len(marks)
        for f in range(1, len(marks)):
            furniture[f] = furniture[marks[f][0]] or not marks[f][1] or not doubted[f] and names(f)
        rows = [(s, w, furniture[f], *rest) for s, w, f, *rest in found]
        out = kept(rows, window, surge)
        if sum(found[k][1] for k in out) * 10 >= whole:
            break
    return " ".join(found[k][0] for k in out)


def extract(df: DataFrame, html: str = "html", output: str = "text", **options) -> DataFrame:
    """``df`` without its html, with the main text of each row in ``output``.

    Null or empty html gives an empty text; character references are decoded,
    white space inside a line is one blank, lines are joined by one blank;
    nothing is cut or capped. Equal pages give equal texts; a column already
    named ``output`` is replaced; an empty table stays empty.
    """
    columns = [c for c in df.columns if c not in (html, output)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in columns)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), **options) for x in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], names=[*columns, output])

    return df.select(*columns, html).mapInArrow(run, f"{fields}, `{output}` string")


def op2_line_blocks(spark, sf_dir):
    from pyspark.sql import functions as F
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
