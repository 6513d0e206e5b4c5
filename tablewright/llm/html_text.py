"""Main text of pages by the distribution of text over lines.

Markup is stripped to lines, one for each block.  A line's weight is its text
outside links; lines of menus, headers, footers, sidebars, notices, adverts,
forms and comments weigh nothing, and each such box leaves a gap of empty lines.
Weights are summed over windows of ``WIDTH`` lines.  Where the sums rise from
nothing, and reach ``THRESHOLD`` before they fall to nothing again, the text
surges; where they do, it dives; the lines between are kept.  A run of lines
that does not reach it is kept if only boxes in the flow of the text (adverts,
asides, forms, marked articles, ...), not menus, headers, footers or comments,
part it from one that does.  Text that the page marks as its article counts twice, and its links
once; runs end where the mark does, and a marked run is joined to the next
marked one if nothing but boxes lies between.  If no run reaches the threshold,
the heaviest is kept.

Class names and ids tell boxes by whole names.  Some words (``sidebar``,
``newsletter``) always do; others (``ad``, ``social``, ``related``) only if the rest
of the attribute says no more (``related-posts`` is a box, ``related-work`` and
``social history`` are not).  Text in ``pre`` and ``code``, and the ids of headings in the
article, which repeat their text, tell nothing.
"""

import html
import re

import pyarrow as pa
from pyspark.sql import functions as F

WIDTH = 3
THRESHOLD = 80

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# fixed values: element names and words of class names
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template", "svg", "noembed", "noframes"}
TO_THE_END = {"script", "style", "title", "textarea"}  # without an end tag they reach to the end of the page
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul xmp".split()
)
BOXES = {"nav", "footer", "aside", "form", "menu", "select", "button", "dialog", "search", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
BOX_WORDS = set(
    "adsense advert adverts advertisement advertisements advertising sponsored sidebar nav navbar navigation breadcrumb breadcrumbs "
    "footer comments commentlist disqus cookie cookies gdpr newsletter signup popup modal toolbar pagination pager masthead topbar".split()
)
# words that also stand in names of other things
VAGUE_WORDS = set(
    "ad ads adv sponsor promo promotion banner menu comment consent notice notices subscribe login share sharing social "
    "related recommended widget copyright header".split()
)
# words that go with them in names of boxes
HELPERS = set(
    "alt area articles author bar block body bottom box btn button buttons center clearfix col column container content count desktop "
    "div even fixed flex follow form full global google grid group head heading icon icons inline inner item items label large "
    "left link links list main media mobile module odd outer overlay page panel parent placeholder post posts primary privacy "
    "reader readers region reply right row secondary section site slot small sticky stories story text thread title tools top unit "
    "us user users view website wide wrap wrapper you".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CODE = {"pre", "code", "samp", "kbd"}
TEXT = HEADINGS | {"p", "blockquote", "figure", "table", "pre", "span"}
INSIDE = {"article", "main"}
# boxes at which the text of a page ends; others interrupt it
END_BOXES = {"nav", "footer", "header", "menu", "head"}
END_ROLES = {"navigation", "banner", "contentinfo", "menu", "menubar"}
END_WORDS = set(
    "header menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus copyright "
    "masthead topbar toolbar pagination pager".split()
)
# what a line is: text outside and inside the article; lines of a gap
PAGE, ARTICLE, GAP, END, MARK = range(5)


def _names_box(value, in_article, strict):
    """Whether a class or id is the name of a box; if strict, ``cookie`` in ``cookie-recipe`` is not."""
    words = [w for w in re.split(r"[\s_-]+", value) if w]
    vague = VAGUE_WORDS - {"header"} if in_article else VAGUE_WORDS
    for token in value.split():
        parts = [w for w in re.split(r"[_-]+", token) if w]
        if any(w in BOX_WORDS for w in parts) and (not strict or all(_goes_with(w, vague) for w in parts)):
            return True
    return any(w in vague for w in words) and all(_goes_with(w, vague) for w in words)


def _goes_with(word, vague):
    return word in BOX_WORDS or word in vague or word in HELPERS or not word.isalpha()


def _box(name, attributes, in_article, in_code):
    """Whether an element is one of the boxes around the main text."""
    if name in BOXES or name == "header" and not in_article:
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    named = False
    for key, *value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape("".join(value)).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in ROLES and not (value == "banner" and in_article):
            return True
        if key == "class" and name == "article":
            named |= bool({"comment", "comments", "ad", "advert", "promo", "related"}.intersection(re.split(r"[\s_-]+", value)))
        elif key == "class" or key == "id" and not (in_article and name in HEADINGS):
            named |= _names_box(value, in_article, in_article or name in TEXT)
    return named and not in_code and name not in ("body", "html", "main")


def _gap(name, attributes):
    """Lines in place of a box."""
    ends = name in END_BOXES
    for key, *value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(value).lower()
        ends |= key == "role" and value in END_ROLES
        ends |= key in ("class", "id") and bool(END_WORDS.intersection(re.split(r"[\s_-]+", value)))
    return [("", 0, END if ends else GAP)] * WIDTH


def lines_of(page):
    """``(text, weight, kind)`` of each line; those of gaps have no text."""
    lines, piece, weight = [], [], 0
    stack, boxes, articles, links, code, unclosed = [], 0, 0, 0, 0, set()

    def flush():
        nonlocal weight
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            if text:
                lines.append((text, weight, ARTICLE if articles else PAGE))
            piece.clear()
        weight = 0

    def leave(k):
        """Closes what is open from place k of the stack on."""
        nonlocal boxes, articles
        for name, box in reversed(stack[k:]):
            if box:
                boxes -= 1
                if not boxes and not articles:
                    lines.extend(box)
            elif name in INSIDE:
                flush()
                articles -= 1
                if not boxes and not articles:
                    lines.extend([("", 0, MARK)] * WIDTH)
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        tag = TAG.search(page, at)
        stop = tag.start() if tag else end
        if stop > at and not boxes:
            said = page[at:stop]
            piece.append(said)
            if not links:
                weight += len(said.strip())
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
        if name in RAW:
            if not closing and not attributes.endswith("/") and name not in unclosed:
                over = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
                if over:
                    at = over.end()
                elif name in TO_THE_END:
                    at = end
                else:
                    unclosed.add(name)
            continue
        if name in BLOCK:
            flush()
            if not closing and stack and stack[-1][0] == "p":
                leave(len(stack) - 1)
        if name == "a":
            links = 0 if closing else 1
        if name == "xmp" and not closing:  # its text is no markup
            over = re.compile("</xmp[^>]*>", re.I).search(page, at)
            said = page[at : over.start() if over else end]
            if not boxes:
                piece.append(html.escape(said))
                weight += 0 if links else len(said.strip())
            at = over.start() if over else end
            continue
        if name in CODE:
            code = max(code - 1, 0) if closing else code + 1
        if name in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush()
                    leave(k)
                    break
            continue
        box = _box(name, attributes, articles > 0, code > 0) and _gap(name, attributes)
        if box:
            flush()
            if not boxes and not articles:
                lines.extend(box)
            boxes += 1
        elif name in INSIDE:
            if not boxes and not articles:
                lines.extend([("", 0, MARK)] * WIDTH)
            articles += 1
        if box or name in BLOCK and name != "p":
            stack.append((name, box))
    flush()
    return lines


def _joined(regions, lines):
    """Groups of regions ``(sum, first, end)`` that belong to one text."""
    groups, last = [], {}
    for region in regions:
        kind = lines[region[1]][2]
        if kind in last:
            between = lines[last[kind][-1][2] : region[1]]
            if kind == ARTICLE:
                join = not any(text for text, _, _ in between)
            else:  # what the article holds is judged by itself
                join = all(own in (GAP, MARK, ARTICLE) for _, _, own in between)
            if join:
                last[kind].append(region)
                continue
        last[kind] = [region]
        groups.append(last[kind])
    return groups


def main_text(page, width=WIDTH, threshold=THRESHOLD):
    lines = lines_of(page)
    weight = [w + len(text) if kind == ARTICLE else w for text, w, kind in lines]
    n = len(lines)
    sums = [0] * (n + 1)
    total = 0
    for i in range(n - 1, -1, -1):
        total += weight[i] - (weight[i + width] if i + width < n else 0)
        sums[i] = total
    regions, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        first = i
        while first < j and not weight[first]:  # the window reaches ahead of the text
            first += 1
        regions.append((max(sums[i:j]), first, j))
        i = j
    groups = _joined(regions, lines)
    kept = [g for g in groups if max(g)[0] >= threshold] or sorted(groups, key=max, reverse=True)[:1]
    return " ".join(text for _, first, j in sorted((r for g in kept for r in g), key=lambda r: r[1]) for text, _, _ in lines[first:j] if text)


def extract(pages, id_col="page_id", url_col="url", html_col="html", width=WIDTH, threshold=THRESHOLD):
    """``<id>, <url>, text, n_chars`` for each row.

    NULL or empty html gives empty text.  Character references are decoded,
    white space inside a line is one space, lines are joined by one space.  Cut
    off or unclosed markup is read to its end.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(page or "", width, threshold) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [id_col, url_col, "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col))
    kinds = [f.dataType.simpleString() for f in rows.schema]
    return rows.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
