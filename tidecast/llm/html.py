"""Main text of web pages: the contiguous region of a page with the largest sum of scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import map_batches, schema_of, table

#: The inside of a tag with quoted values, up to its end. Possessive, so that a tag without an end is given up at once.
QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: Text, and signs of less that begin nothing.
PLAIN = re.compile(r"(?:[^<]++|<(?![a-zA-Z!?]|/[a-zA-Z]))++")
#: The end of a sentence, and the words from which on a block with one looks like a part of a text.
SENTENCE = re.compile(r"[.!?…。！？:][\"'”’)]*(?:\s|$)")
LEAST_BLOCK = 8
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
UNSEEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
#: Fixed values of HTML: elements without content, elements whose content is not markup, elements that start a block,
#: and those that end an open one of the same kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg iframe object canvas".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_ITSELF = set("p li dt dd option tr td th".split())
#: What elements are, by their name, and by words of class, id and role.
ELEMENTS = {
    "head": "head", "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "button": "form",
    "select": "form", "dialog": "notice", "article": "article", "main": "article",
}
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs",
    "header": "header masthead banner topbar",
    "footer": "footer contentinfo copyright colophon",
    "side": "sidebar side aside complementary widget related recommended share sharing social tags",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion",
    "notice": "cookie cookies consent notice popup modal dialog overlay gdpr alert newsletter subscribe paywall",
    "form": "form search login signup",
    "comments": "comment comments reply replies respond discussion disqus",
    "article": "article post story entry main content body-text",
}
ROLES = {word: role for role, words in WORDS.items() for word in words.split()}
#: Parts of a class that say how something is shown or what else there is, not what it is.
STATES = set("has no is with without not js open closed fixed sticky enabled disabled active on off inactive".split())
#: Elements that hold parts of a page; others are parts of a text, whatever their class says of it.
CONTAINERS = set("article main section div".split())
INLINE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th span a b i em strong u small q cite code font mark".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Roles whose text is not part of an article that they stand in.
OUTSIDE = ("head", "menu", "header", "footer", "side", "ad", "notice", "form", "comments", "unseen")


@dataclass(frozen=True)
class Text:
    """Text between two tags: the role it stands in, its block, the outermost article around it (0: none), if it is in a link
    and in a page's heading."""

    words: str
    role: str
    block: int
    article: int
    linked: bool = False
    heading: bool = False


def pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """``kind, name or text, inside`` of the parts of a page: ``text``, ``open`` and ``close``.

    What is not a tag is text; a tag that the page's end cuts off, comments and declarations are nothing. Each character is
    looked at a bounded number of times: once a quoted value has no end, tags go to the next ``>``, and once there is none of
    these either, no more tags begin.
    """
    at, quotes, size, last = 0, True, len(html), html.rfind(">")
    while at < size:
        if (text := PLAIN.match(html, at)) is not None:
            yield "text", text[0], ""
            at = text.end()
            continue
        if at > last:  # no tag ends any more
            comment, tag = html.find("<!--", at), html.rfind("<")
            end = comment if comment >= 0 else tag if NAME.match(html, tag + 1) else size
            if end > at:
                yield "text", html[at:end], ""
            return
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            at = html.index(">", at) + 1
            continue
        begin, name = at, NAME.match(html, at + 1)
        end = QUOTED.match(html, name.end()) if quotes else None
        if end is None:
            quotes = False
            stop = html.index(">", begin) + 1
        else:
            stop = end.end()
        yield ("close" if html[begin + 1] == "/" else "open"), name[1].lower(), html[name.end() : stop - 1]
        at = stop


def role_of(name: str, marks: str, inside: str) -> tuple[str | None, bool]:
    """The role that an element takes, and whether only a part of a class or id says so.

    Elements say most. Of classes and ids, whole words count before parts of words; words of state say nothing, and on
    ``html`` and ``body`` none counts. In an article, headings keep it, and texts leave it neither as headers nor notices.
    """
    if UNSEEN.search(marks):
        return "unseen", False
    role = ELEMENTS.get(name)
    own = role == "header" and inside == "article"  # an article's own heading
    if role is not None and not own and role != "article":
        return role, False
    if name in ("html", "body") or name in HEADINGS and inside == "article":
        return role if not own else None, False
    whole, part = [], []
    for m in MARKS.finditer(marks):
        for token in re.split(r"[\s]+", (m[2] or m[3] or m[4] or "").lower()):
            if token in ROLES:
                whole.append(ROLES[token])
            else:
                words = re.split(r"_+|-+", token)
                if len(words) > 1 and not STATES.intersection(words):
                    part += [ROLES[w] for w in words if w in ROLES]
    quiet = ("header", "notice") if inside == "article" and (name in INLINE or own) else ("header",) if inside == "article" else ()
    whole, part = ([r for r in found if r not in quiet] for found in (whole, part))
    if out := next((r for r in whole if r in OUTSIDE), None):
        return (out, False) if "article" not in whole or name not in CONTAINERS else ("article", False)
    if role == "article" or "article" in whole and name in BLOCK:
        return "article", False
    if out := next((r for r in part if r in OUTSIDE), None):
        return out, True
    return ("article", True) if part and name in BLOCK else (None, False)


def scan(html: str) -> Iterator[Text | str]:
    """Texts, and names of the tags between them, in page order."""
    stack: list[tuple[str, str, int, bool]] = []  # element, role, article, whether a part of a class gave the role
    open_of: Counter[str] = Counter()
    block, articles, skip = 0, 0, ""

    def leave(keep: int) -> None:
        for name, *_ in stack[keep:]:
            open_of[name] -= 1
        del stack[keep:]

    for kind, name, marks in pieces(html):
        if kind == "text":
            if not skip:
                _, role, article, _ = stack[-1] if stack else ("", "plain", 0, False)
                yield Text(unescape(name), role, block, article, open_of["a"] > 0, open_of["h1"] > 0)
            continue
        if skip:
            if kind == "close" and name == skip:
                skip = ""
            continue
        if name in BLOCK:
            block += 1
        yield name
        if kind == "close":
            if open_of[name]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
        elif name in RAW:
            skip = "" if marks.endswith("/") else name
        elif name not in VOID:
            if name in ENDS_ITSELF:
                near = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 5), -1) if stack[i][0] == name), None)
                if near is not None and not any(e in BLOCK and e not in ("p", "li", "td", "th", "tr", "dt", "dd") for e, *_ in stack[near + 1 :]):
                    leave(near)
            _, inside, article, weak = stack[-1] if stack else ("", "plain", 0, False)
            role, partly = role_of(name, marks, inside)
            # an article wins its role back from what only a part of a class gave
            taken = role is not None and (inside not in OUTSIDE or weak and role == "article" and not partly)
            if taken and role == "article" and name in CONTAINERS and not article:
                articles += 1
                article = articles
            stack.append((name, role if taken else inside, article, partly if taken else weak))
            open_of[name] += 1


def kinds(tokens: list[Text | str]) -> Iterator[str]:
    """What a token is scored as: a tag by its name; words by their role, and plain ones by what their block looks like."""
    words, linked, said = Counter(), Counter(), set()
    for t in tokens:
        if isinstance(t, Text):
            n = len(t.words.split())
            words[t.block] += n
            linked[t.block] += n * t.linked
            if SENTENCE.search(t.words):
                said.add(t.block)
    for t in tokens:
        if isinstance(t, str):
            yield f"tag {t}"
        elif t.role != "plain":
            yield f"word {t.role}"
        elif t.heading:
            yield "word plain heading"
        elif 2 * linked[t.block] > words[t.block]:
            yield "word plain linked"
        else:
            yield "word plain" if t.block in said and words[t.block] >= LEAST_BLOCK else "word plain short"


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous part with the largest sum, the first such; empty if no sum is positive. One pass."""
    best, at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, at = total, (begin, i + 1)
    return at


def learn_weights(labelled: Iterable[tuple[str, str]]) -> dict[str, float]:
    """Scores from pages and their main texts, one block a line: of a word by the role it stands in, of a tag by its name.

    They are log odds of standing in the main text against standing elsewhere. A tag's is negative at any rate, and
    small against a word's, so that marked-up text holds together and lists of links do not.
    """
    inside, outside = Counter(), Counter()
    for html, main in labelled:
        wanted, tags, is_in = {x for x in main.split("\n") if x}, [], False
        blocks: dict[int, str] = {}
        tokens = list(scan(html))
        for t in tokens:
            if isinstance(t, Text):
                blocks[t.block] = blocks.get(t.block, "") + t.words
        for t, kind in zip(tokens, kinds(tokens), strict=True):
            if isinstance(t, str):
                tags.append(kind)
            elif n := len(t.words.split()):
                now = " ".join(blocks[t.block].split()) in wanted
                (inside if now else outside)[kind] += n
                for tag in tags:
                    (inside if now and is_in else outside)[tag] += 1
                tags, is_in = [], now
    odds = {k: log((inside[k] + 0.5) / (outside[k] + 0.5)) for k in inside | outside}
    return {k: max(-3.0, min(3.0, v)) if k.startswith("word") else max(-0.5, min(-0.01, 0.1 * v)) for k, v in odds.items()}


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region without what stands in another role there, from the begin to the end of its articles.

    An article that the region touches is taken whole. Where most words of the region stand in articles, it is cut to what
    lies between the first begin and the last end of these.
    """
    tokens = list(scan(html or ""))
    told = list(kinds(tokens))
    default = {f"word {role}": -1.0 for role in OUTSIDE} | {"word article": 1.0}
    counts = [0 if isinstance(t, str) else len(t.words.split()) for t in tokens]
    scores = [weights.get(k, -0.1) if isinstance(t, str) else weights.get(k, default.get(k, 0.1)) * n for t, k, n in zip(tokens, told, counts, strict=True)]
    begin, end = best_region(scores)
    if begin == end:  # nothing looks like a text: short plain words then are
        begin, end = best_region([0.1 * n if k == "word plain short" else s for s, k, n in zip(scores, told, counts, strict=True)])
    kept = [n if n and t.role not in OUTSIDE else 0 for t, n in zip(tokens, counts, strict=True)]
    touched = {tokens[i].article for i in range(begin, end) if kept[i] and tokens[i].article}
    if touched:
        own = [i for i, t in enumerate(tokens) if isinstance(t, Text) and t.article in touched]
        among = [i for i in range(begin, end) if kept[i]]
        if 2 * sum(kept[i] for i in among if tokens[i].article) >= sum(kept[i] for i in among):
            among = [i for i in among if tokens[i].role == "article" or tokens[i].heading]
        begin, end = min([*own[:1], *among[:1]]), max([*own[-1:], *among[-1:]]) + 1
    blocks: dict[int, list[str]] = {}
    for t in tokens[begin:end]:
        if isinstance(t, Text) and t.role not in OUTSIDE:
            blocks.setdefault(t.block, []).append(t.words)
    return "\n".join(x for b in blocks.values() if (x := " ".join("".join(b).split())))


def _page(*, menu="", top="", side="", notice="", advert="", form="", comments="", foot="", main=(), bare=False) -> tuple[str, str]:
    """A labelled page: the parts around its main text and the blocks of that."""
    body = "".join(f"<h1>{x}</h1>" if i == 0 else f"<p>{x}</p>" for i, x in enumerate(main))
    around = "".join((
        menu and "<nav><ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in menu.split()) + "</ul></nav>",
        top and f"<header><div>{top}</div></header>", notice and f'<div class="cookie-notice"><p>{notice}</p></div>',
        advert and f'<div class="ad">{advert}</div>',
    ))
    after = "".join((
        side and f"<aside><h3>More</h3><p>{side}</p></aside>", form and f"<form><label>{form}</label><input></form>",
        comments and f'<div id="comments"><p>{comments}</p></div>', foot and f"<footer>{foot}</footer>",
    ))
    held = f'<div class="content">{body}</div>' if bare else f"<article>{body}</article>"
    return f"<html><head><title>{main[0]}</title></head><body>{around}{held}{after}</body></html>", "\n".join(main)


def _plain(*, links="", before=(), after=(), main=()) -> tuple[str, str]:
    """A labelled page whose parts no class, id or element tells apart."""
    menu = "<div>" + "".join(f'<div><a href="/{x}">{x}</a></div>' for x in links.split()) + "</div>"
    parts = ["".join(f"<div>{x}</div>" if x.endswith(".") or xs is not main else f"<h1>{x}</h1>" for x in xs) for xs in (before, main, after)]
    return f"<html><body>{menu}<div>{parts[0]}</div><div>{parts[1]}</div><div>{parts[2]}</div>{menu}</body></html>", "\n".join(main)


#: Labelled pages, made up by hand after common layouts.
LABELLED = (
    _page(
        menu="Home News Sport Weather Contact", top="The Valley Post, founded 1890", advert="Buy two lamps and get one free today",
        foot="All rights reserved. The Valley Post", side="Ten walks that you must not miss this year",
        main=("River reaches its highest level in a decade", "The water rose through the night and reached the lower road at dawn.",
              "Crews closed the bridge and asked drivers to take the <b>northern</b> route until the evening.",
              "No one was hurt, and the level is expected to fall from tomorrow on."),
    ),
    _page(
        menu="Start Recipes Shop About", notice="We use cookies to make this site better. Accept all?", form="Your mail address",
        comments="Great recipe, thank you! Mine took an hour longer.", foot="Made with care in a small kitchen",
        main=("Bread without kneading", "Stir flour, water, salt and a little yeast and leave the bowl alone overnight.",
              "Fold the dough twice in the morning, let it rest, and bake it in a hot pot with the lid on."),
    ),
    _page(
        menu="Docs Download Blog", side="Recent posts and popular tags", advert="Try our hosting for thirty days", foot="Terms and privacy",
        main=("Release notes", "This version reads files in parallel.", "Old settings keep working.", "Thanks to all who sent reports."),
        bare=True,
    ),
    _page(
        menu="Search Login", top="Forum of the gardeners", comments="I agree with the first post. So do I.", form="Write a reply",
        main=("When to cut roses", "Cut them when the forsythia is in bloom, above an outward bud, and take out all dead wood."),
    ),
    _plain(
        links="Home Maps Shops Help Contact", before=("Your city guide", "Monday edition"), after=("All rights reserved", "Imprint and privacy", "Back to top"),
        main=("The old mill opens again", "After four years of work the mill on the river is open to visitors from Tuesday to Sunday.",
              "Guides show the wheel, the stones and the miller's room, and on Saturdays flour is ground as it was then."),
    ),
    _plain(
        links="Start Archive Authors Feed", before=("Notes on clocks",), after=("Older notes", "Newer notes", "Share this page", "Written in spare time"),
        main=("A pendulum loses a few seconds each day when the room gets warm, because its rod grows a little longer.",
              "A rod of two metals that pull against each other keeps its length, and with it the clock keeps its time.",
              "Makers have used such rods for three hundred years, and a good one still holds within a second a week."),
    ),
)


def extract(df: DataFrame, weights: dict[str, float], *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of ``df``, ``text`` and ``n_chars``: the main text of each page, blocks joined by line breaks.

    Words score by the role of what they stand in, plain ones by what their block looks like, tags by their name; one pass
    finds the contiguous part with the largest sum. Articles in it are taken to their ends. Menus, forms, adverts and the
    like inside it are left out. The work is linear in the page, however broken its markup. Character references are decoded, white space in a block becomes one space.

    A page without any words of positive score gives its short plain words; a null or empty page, or one without these, has
    empty text. Columns of ``df`` named like those added are left out unless they are in ``keep``, which is an error. Nothing is cut off, however long.
    """
    if {"text", "n_chars"} & {k.lower() for k in keep}:
        raise ValueError("text and n_chars are added and cannot be kept")
    source = df.select(*keep, F.col(html_col).alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py(), weights) for x in batch.column(len(keep))]
        arrays = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=[*keep, "text", "n_chars"])

    return map_batches(source, run, schema_of(df.select(*keep), text=T.StringType(), n_chars=T.LongType()))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), learn_weights(LABELLED))
