"""Operator 6: main text of web pages from a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between borders of block-level elements. Each block has features from
its ancestors' tags and class words, from its own text, and from all text of the container it stands in (how long its
blocks are, how much of it is links); the field labels all blocks of a page together (Viterbi).
It is trained on labelled pages: labelled_pages() lays articles out in many ways among menus, headers, sidebars, notices,
adverts, forms, comments and footers, a third of them without any telling tag or class word; labelled pages of one's own
can be added. Extraction is one pass, without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.llm.common import read, unused
from geotally.llm.crf import Chains, Model, viterbi

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: Elements whose content is no markup (it ends at their end tag alone), others whose content is not text of the page, elements that
#: hold no content, and elements that break text into blocks.
RAW = frozenset("script style title textarea iframe".split())
HIDDEN = frozenset("template noscript select option optgroup object svg canvas audio video annotation annotation-xml".split())
ENDS = re.compile(rf"</({'|'.join(sorted(RAW | HIDDEN))})(?=[\s/>])", re.I | re.A)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header head hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"head": BLOCK, "p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Elements that end an svg element which is still open.
LEAVES_SVG = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li menu ol p pre table ul article main section footer".split())
#: Words of class, id and role attributes that tell what an element holds, and elements that do.
KINDS = {
    "nav": "nav menu menubar navigation navbar breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead topbar banner branding logo",
    "footer": "footer foot colophon copyright contentinfo legal",
    "aside": "sidebar aside related recommended widget complementary rail promo trending popular newsletter subscribe share social",
    "ad": "ad ads advert advertisement adverts sponsored sponsor adsbygoogle",
    "notice": "cookie cookies consent notice gdpr alert warning popup modal disclaimer paywall",
    "comment": "comment comments comentarios kommentare commentaires disqus replies respond discussion",
    "form": "form search login signup",
    "content": "content article post entry story body text main prose article-body post-content entry-content story-body",
}
KIND_OF = {w: k for k, words in KINDS.items() for w in words.split()}
TAG_KIND = {"nav": "nav", "menu": "nav", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "label": "form", "fieldset": "form", "dialog": "notice", "article": "article", "main": "main", "header": "header"}
NOISE = ["none", "nav", "header", "footer", "aside", "ad", "notice", "comment", "form"]
HOLDERS = ["none", "content", "main", "article"]
OWN = {"p": 1, "h1": 2, "h2": 3, "h3": 3, "h4": 3, "h5": 3, "h6": 3, "li": 4, "pre": 5, "blockquote": 5, "td": 6, "th": 6, "div": 7, "section": 7, "dt": 4, "dd": 4, "figcaption": 8, "article": 7, "main": 7}
#: Elements within a container, whose texts are judged together; on them a class word with parts of content and of something else tells nothing.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol pre blockquote dt dd dl figcaption figure".split())
VALUES, FEATURES = 10, 11
MARK = "\ue000"
LENGTHS, LINKS, WORDS = np.array([8, 20, 50, 120, 300, 800]), np.array([0.01, 0.3, 0.6, 0.9]), np.array([2, 4, 8, 16, 40])


@cache
def _kind(tag: str, attributes: str) -> str:
    """What an element holds, by its class words or else its tag; "" if neither tells. Of a word's parts what isn't content counts first."""
    if attributes:
        for value in re.findall(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", attributes, re.I)[:6]:
            for word in value.strip("\"'").lower().split():
                found = {KIND_OF[part] for part in (word, *re.split(r"[-_]", word)) if part in KIND_OF}
                if tag in PARTS and "content" in found:
                    continue
                for k in KINDS:
                    if k in found and not (k == "header" and (tag in ("h1", "h2", "h3") or "content" in found)):
                        return k
    return TAG_KIND.get(tag, "")


def kind(tag: str, attributes: str) -> str:
    if _kind.cache_info().currsize > 50_000:
        _kind.cache_clear()
    return _kind(tag, attributes)


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Leaf blocks of a page, in order: their texts and their features [block, feature]."""
    stack: list[tuple[str, str, int]] = []  # tag, kind, number
    texts: list[str] = []
    found: list[tuple] = []
    parts: list[str] = []
    linked = links = 0
    elements = 0
    at, hidden, inner = 0, "", Counter()  # inner: what is open inside the hidden element
    last_end: dict[str, int] | None = None

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                texts.append(text)
                found.append((text, linked, tuple(stack)))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if links:
            linked += len(raw)

    def ends(tag: str) -> bool:
        """Whether an end tag of this name comes later."""
        nonlocal last_end
        if last_end is None:
            last_end = {m[1].lower(): m.start() for m in ENDS.finditer(page)}
        return last_end.get(tag, -1) >= at

    while m := TOKEN.search(page, at):
        if m.start() > at and not hidden:
            say(page[at : m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        tag, closing = name.lower(), bool(m.group(1) or m.group(4))
        if tag in RAW and not closing:
            end = next((e for e in ENDS.finditer(page, at) if e[1].lower() == tag), None) if ends(tag) else None
            if end:
                at = end.start()
            elif tag in ("script", "style"):
                at = len(page)
            continue
        if hidden:
            if closing and inner[tag]:
                inner[tag] -= 1
                continue
            if closing and tag == hidden:
                hidden = ""
                continue
            outside = closing and any(tag == t for t, _, _ in stack)  # the end of what the hidden element stands in
            if not outside and not (hidden == "svg" and not closing and tag in LEAVES_SVG and not inner["foreignobject"]):
                if not closing and tag not in VOID:
                    inner[tag] += 1
                continue
            hidden = ""
        if not closing and tag in HIDDEN:
            if ends(tag) and not (tag == "svg" and m.group().endswith("/>")):
                hidden, inner = tag, Counter()
            elif tag in ("option", "optgroup", "select"):  # without an end tag: hides text up to the next tag
                text = TOKEN.search(page, at)
                at = text.start() if text else len(page)
        elif tag in BLOCK:
            close()
            links = 0
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            else:
                while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                    stack.pop()
                if tag not in VOID:
                    elements += 1
                    stack.append((tag, kind(tag, m.group(3) or m.group(6) or ""), elements))
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in VOID:
            parts.append(" ")
    if not hidden:
        say(page[at:])
    close()
    return texts, _features(found)


def _features(found: list[tuple]) -> np.ndarray:
    x = np.zeros((len(found), FEATURES), np.uint8)
    around, places = {}, []  # container: blocks, characters, linked characters
    for text, linked, stack in found:
        above = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in PARTS), -1)
        places.append(stack[above][2] if above >= 0 else 0)
        sums = around.setdefault(places[-1], [0, 0, 0])
        for j, v in enumerate((1, len(text), linked)):
            sums[j] += v
    held = any(k in HOLDERS for _, _, stack in found for _, k, _ in stack)
    for i, (text, linked, stack) in enumerate(found):
        holder, noise, inside = "none", "none", 0 if held else 2  # 2: nothing on this page is said to hold the content
        for _, k, _ in stack:
            if k in HOLDERS:
                holder, inside = k if HOLDERS.index(k) > HOLDERS.index(holder) else holder, 1
            elif k and not (k == "header" and holder != "none"):
                noise = k
        own, outer = (stack[-1][0] if stack else ""), (stack[-2][0] if len(stack) > 1 else "")
        words = text.count(" ") + 1
        blocks_, chars, links = around[places[i]]
        x[i] = (
            HOLDERS.index(holder), NOISE.index(noise), OWN.get(own, 9), np.searchsorted(LENGTHS, len(text)), np.searchsorted(LINKS, linked / max(1, len(text))),
            np.searchsorted(WORDS, words), 1 + (text[-1] in ".!?…:;\"'»”"), 4 * ("©" in text) + inside,
            OWN.get(outer, 9), np.searchsorted(LENGTHS, chars / blocks_), np.searchsorted(LINKS, links / max(1, chars)),
        )
    return x


def labelled_pages() -> Iterator[tuple[str, list[int]]]:
    """Pages with a label (1: main text) for each of their blocks, laid out in many ways; always the same.

    The label of a block is where the layout put it: each page is laid out with a mark before its main blocks as well.
    """
    rng = np.random.default_rng(7)
    words = "the of river stone under light many people house went over small green when time market city old water and field road".split()

    def sentence(a: int, b: int) -> str:
        return " ".join(rng.choice(words, rng.integers(a, b))).capitalize() + rng.choice([".", ".", "!", ""])

    wrap = [("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="content">', "</div>"), ('<section class="story">', "</section>"), ('<main role="main"><div class="entry">', "</div></main>")]
    bare = [("<div>", "</div>"), ("<div><div>", "</div></div>"), ("", ""), ('<div class="x1 c-20">', "</div>"), ("<section>", "</section>"), ('<div id="root"><div>', "</div></div>"), ("<table><tr><td>", "</td></tr></table>")]
    noise = [
        ('<nav><ul>{}</ul></nav>', "<li><a href=x>{}</a></li>", 1, 3), ('<div class="menu">{}</div>', "<a href=x>{}</a> ", 1, 3), ("<header>{}</header>", "<div>{}</div>", 1, 6), ("<aside>{}</aside>", "<p>{}</p>", 2, 14),
        ('<div class="sidebar"><ul>{}</ul></div>', "<li><a href=x>{}</a>", 2, 6), ('<div class="ad">{}</div>', "{}", 2, 14), ('<div class="cookie-notice">{}</div>', "<p>{}</p>", 4, 16), ("<form>{}</form>", "<label>{}</label>", 1, 4),
        ('<div id="comments">{}</div>', '<p class="reply">{}</p>', 2, 20), ('<section class="comments"><h3>Comments</h3>{}</section>', "<div>{}</div>", 2, 20), ("<footer>{}</footer>", "&copy; {}", 2, 10), ('<div class="footer">{}</div>', "<p>{}</p>", 2, 10),
    ]
    plain = [("<div>{}</div>", "<a href=x>{}</a> ", 1, 3), ("<ul>{}</ul>", "<li><a href=x>{}</a></li>", 1, 4), ("<div><ul>{}</ul></div>", "<li><a href=x>{}</a>", 1, 6), ('<div class="c-7">{}</div>', "<p><a href=x>{}</a></p>", 2, 8), ("<div>{}</div>", "<div>&copy; {}</div>", 2, 6)]
    classes = ["", "", "", "", ' class="c1"', ' class="text-share"', ' class="story-alert"', ' class="lead"', ' class="body-popular"']

    def clutter(some: list) -> str:
        out = []
        if rng.random() < 0.25:
            return ""
        for i in rng.permutation(len(some))[: rng.integers(1, 5)]:
            outer, inner, a, b = some[i]
            out.append(outer.format("".join(inner.format(sentence(a, b)) for _ in range(rng.integers(1, 6)))))
        return "".join(out)

    for n in range(600):
        untold = n % 3 == 2
        first, last = (bare if untold else wrap)[n // 3 % 7]
        before, within, after = (noise[:8] + plain, plain[:0], plain + noise[10:]) if untold else (noise[:10] + plain[:2], noise[3:10], noise[3:] + plain)
        body = []
        for k in range(rng.integers(2 if untold else 1, 14)):
            text = sentence(1, 8) if k == 0 or rng.random() < 0.25 or (n % 5 == 0 and not untold) else sentence(5 if untold else 4, 60)
            tag = "h1" if k == 0 and n % 3 else rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote", "pre"])
            if untold and k == 1:
                tag, text = "p", sentence(15, 60)
            if tag == "p" and rng.random() < 0.1:
                text = f"{text} <a href=x>{sentence(1, 3)}</a> {sentence(3, 9)}"
            if k and rng.random() < 0.1:
                body.append("<ul>" + "".join(f"<li>{MARK}{sentence(1, 6)}</li>" for _ in range(rng.integers(2, 5))) + "</ul>")
            body.append(f"<{tag}{rng.choice(classes) if tag == 'p' else ''}>{MARK}{text}" + (f"</{tag}>" if tag != "p" or n % 2 else ""))
            if within and n % 4 == 0 and rng.random() < 0.1:
                body.append(clutter(within))
        if within and n % 4 == 0:
            body.append(clutter(within))
        page = f"<html><head><title>t</title></head><body>{clutter(before)}{first}{''.join(body)}{last}{clutter(after)}</body></html>"
        yield page.replace(MARK, ""), [int(t.startswith(MARK)) for t in blocks(page)[0]]


@cache
def trained() -> Model:
    """The field fitted to labelled_pages()."""
    xs, ys = [], []
    for page, labels in labelled_pages():
        xs.append(blocks(page)[1])
        ys += labels
    chains = Chains(np.array([len(x) for x in xs]))
    return Model(FEATURES, VALUES).fit(np.concatenate(xs), np.array(ys), chains, rounds=300)


def extracted(df: DataFrame, model: Model | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text and n_chars (code points) of every page.

    Null and empty pages, and pages of which no block is main text, give an empty text. Repeated rows each give theirs.
    Very long pages are taken whole, in the memory of one task. An empty table gives none.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or trained())  # a few hundred numbers
    source = df.select(*keep, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias(unused(df, "whole_html")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                pages = [blocks(v.as_py()) for v in batch.column(batch.num_columns - 1)]
                some = [i for i, (t, _) in enumerate(pages) if t]
                out = [""] * len(pages)
                if some:
                    x, chains = np.concatenate([pages[i][1] for i in some]), Chains(np.array([len(pages[i][0]) for i in some]))
                    main, k = viterbi(field.score(x, chains), field.moves, chains), 0
                    for i in some:
                        texts = pages[i][0]
                        out[i] = "\n\n".join(t for t, good in zip(texts, main[k : k + len(texts)], strict=True) if good)
                        k += len(texts)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [*keep, "text", "n_chars"])

    return source.mapInArrow(run, f"{fields}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
