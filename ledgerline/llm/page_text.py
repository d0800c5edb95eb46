"""Main text of HTML pages by a linear-chain conditional random field (operator 5).

A page becomes the sequence of its leaf blocks: runs of text between block-level tags,
each with its ancestors. Features are the ancestors' tags and the words of their class,
id and role, and properties of the text. Two labels, main text or not; the model is
trained by gradient ascent on the log-likelihood of labelled pages (forward-backward)
and decoded by Viterbi. Labelled pages are (html, main text) pairs: a block is main
text if it is a line of it. ``labelled_pages`` makes the bounded training set.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict
from collections.abc import Callable, Container, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import bound_batches, table
from ledgerline.llm.line_dup import BLOCK_TAGS

TRAINING_PAGES, EPOCHS, RATE, PENALTY = 1000, 10, 0.3, 1e-4
SEED = 11

_BLOCKS = frozenset(BLOCK_TAGS) - {"br", "body", "html"} | {"button", "iframe", "label", "nav", "textarea", "caption", "thead", "tbody", "center", "summary", "details"}
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: Elements that hold no tags and whose content is never text of the page; they run to their closing tag.
_RAW = ("script", "style", "title", "textarea", "iframe")
#: Of these, what runs to the end of the page without a closing tag; the others hold what follows.
_CODE = frozenset({"script", "style"})
#: Elements whose text is judged apart; without text they do not break the block around them.
_ISLANDS = frozenset({"noscript", "template", "select", "object", "canvas", "svg"})
#: Tags that a new block-level element closes.
_CLOSED_BY_BLOCK = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6"})
_CLOSED_BY_SELF = frozenset({"li", "dt", "dd", "td", "th", "tr", "option"})
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""")
_ODD_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in _RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words that mark short texts around an article.
_CUES = frozenset(
    "ad ads advert advertisement sponsored promoted cookie cookies consent accept privacy terms rights reserved copyright subscribe newsletter email login "
    "register password search share tweet reply replies comment comments posted says menu home next previous related trending tags".split()
)
_CUE_WORDS = re.compile(r"[a-z]+")


def blocks(page: str, known: Container[str] | None = None) -> list[tuple[str, frozenset[str]]]:
    """(text, features) of every leaf block with text, in page order.

    Of the ancestors' features, only the ``known`` ones are kept, if any are told. Every
    step either moves on in the page or closes what an earlier one opened, so pages of
    any nesting and of tags that never close take time in proportion to their length.
    """
    found: list[tuple[str, frozenset[str]]] = []
    last = page.rfind(">")
    opened: dict[str, int] = defaultdict(int)
    stack: list[tuple[str, frozenset[str], frozenset[str]]] = [("", frozenset(), frozenset())]
    held: list[str] = []
    linked, links = 0, 0
    # around the open islands: (their level, and the text, linked and links that they interrupt); the first ``told`` are written
    around: list[tuple[int, list[str], int, int]] = []
    told = 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked, told
        text = " ".join(entities.unescape("".join(held)).split()) if held else ""
        if text:
            for k in range(told, len(around)):
                level, parts, n, open_links = around[k]
                before = " ".join(entities.unescape("".join(parts)).split())
                if before:
                    found.append((before, _features(before, n, stack[level - 1])))
                around[k] = level, [], 0, open_links
            told = len(around)
            found.append((text, _features(text, linked, stack[-1])))
        held.clear()
        linked = 0

    def leave(level: int) -> None:
        """Close the islands from this level on and go on with what is around them."""
        nonlocal linked, links, told
        while around and around[-1][0] >= level:
            flush()
            island, parts, linked, links = around.pop()
            told = min(told, len(around))
            cut(island)
            held.extend(parts)

    def cut(level: int) -> None:
        """Close the elements from this level on."""
        while len(stack) > level:
            opened[stack.pop()[0]] -= 1

    def place(tag: str) -> int:
        """The level of the innermost open element of this name; 0 if there is none."""
        return next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag) if opened[tag] > 0 else 0

    def push(tag: str, attributes: str) -> None:
        opened[tag] += 1
        stack.append(_opened(tag, attributes, stack[-1], known))

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            held.append(page[at:start])
            linked += start - at if links else 0
        if start == end:
            break
        m = (_TAG.match(page, start) or _ODD_TAG.match(page, start)) if start < last else None
        if m is None:
            after = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                at = page.find("-->", start + 4) + 3
                at = end if at < 3 else at
            elif after in ("!", "?", "/") or after.isalpha():  # a declaration, or a tag that the end of the page cuts
                at = page.find(">", start) + 1 or end
            else:
                held.append("<")
                at = start + 1
            continue
        at = m.end()
        closes, tag = m.group(1), m.group(2).lower()
        empty = m.group(3).endswith("/")
        if tag in _CLOSING and not closes and tag not in unclosed:
            if empty and opened["svg"] > 0:
                continue
            stop = _CLOSING[tag].search(page, at)
            if stop or tag in _CODE:
                at = stop.end() if stop else end
                continue
            unclosed.add(tag)
        if tag in _ISLANDS:
            if closes:
                level = place(tag)
                if level:
                    leave(level)
            elif not empty:
                around.append((len(stack), held.copy(), linked, links))
                held.clear()
                linked = links = 0
                push(tag, m.group(3))
        elif tag == "a":
            links = max(0, links - 1) if closes else links + 1
        elif tag in ("br", "annotation"):
            held.append(" ")
        elif tag in _BLOCKS:
            level = place(tag) if closes else 0
            if level:
                leave(level)
            flush()
            links = 0
            if closes:
                if level:
                    cut(level)
            else:
                if stack[-1][0] in _CLOSED_BY_BLOCK or (stack[-1][0] == tag and tag in _CLOSED_BY_SELF):
                    cut(len(stack) - 1)
                if tag not in _VOID and not empty:
                    push(tag, m.group(3))
    leave(0)
    flush()
    return found


def _opened(tag: str, attributes: str, above: tuple[str, frozenset[str], frozenset[str]], known: Container[str] | None) -> tuple[str, frozenset[str], frozenset[str]]:
    """(tag, features of it and its ancestors, features of it alone)."""
    names = [w.lower() for name in _NAMES.findall(attributes) for w in _NAME_WORDS.findall("".join(name))] if "=" in attributes else []
    inherited = {f"in:{tag}", *(f"name:{w}" for w in names)}
    if known is not None:
        inherited = {f for f in inherited if f in known}
    return tag, above[1] if inherited <= above[1] else above[1] | inherited, frozenset((f"tag:{tag}", *(f"near:{w}" for w in names)))


def _features(text: str, linked: int, top: tuple[str, frozenset[str], frozenset[str]]) -> frozenset[str]:
    n = text.count(" ") + 1
    share = linked / len(text)
    own = {
        f"words:{0 if n < 3 else 1 if n < 6 else 2 if n < 11 else 3 if n < 21 else 4 if n < 41 else 5}",
        f"link:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}",
        f"closed:{text[-1] in '.!?:;…”»'}",
        f"copyright:{'©' in text}",
        f"{top[0]}:{'long' if n > 15 else 'short'}",
    }
    if n <= 20:
        own.update(f"cue:{w}" for w in _CUE_WORDS.findall(text.lower()) if w in _CUES)
    return top[1] | top[2] | own


class Chain:
    """Weights of features for main text against the rest, and of label changes."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.step = np.zeros((2, 2))

    def emission(self, page: list[tuple[str, frozenset[str]]]) -> list[float]:
        get = self.weight.get
        return [sum(get(f, 0.0) for f in features) for _, features in page]

    def viterbi(self, scores: list[float]) -> list[bool]:
        """The best labels of a sequence; ties go to other text."""
        (oo, om), (mo, mm) = self.step.tolist()
        other, main = 0.0, scores[0] if scores else 0.0
        back = []
        for s in scores[1:]:
            from_other, from_main = main + mo > other + oo, main + mm > other + om
            back.append((from_other, from_main))
            other, main = max(other + oo, main + mo), s + max(other + om, main + mm)
        label = main > other
        out = [label] if scores else []
        for from_other, from_main in reversed(back):
            label = from_main if label else from_other
            out.append(label)
        return out[::-1]

    def extract(self, page: str) -> str:
        found = blocks(page, self.weight)
        return "\n".join(text for (text, _), main in zip(found, self.viterbi(self.emission(found)), strict=True) if main)


def _marginals(scores: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of main text at each block, expected label changes)."""
    n = len(scores)
    local = np.stack([np.zeros(n), scores], axis=1)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = local[0]
    for t in range(1, n):
        ahead[t] = local[t] + np.logaddexp(ahead[t - 1, 0] + step[0], ahead[t - 1, 1] + step[1])
    for t in range(n - 2, -1, -1):
        to = step + local[t + 1] + behind[t + 1]
        behind[t] = np.logaddexp(to[:, 0], to[:, 1])
    total = np.logaddexp(*ahead[-1])
    changes = np.zeros((2, 2))
    if n > 1:
        joint = ahead[:-1, :, None] + step[None] + (local + behind)[1:, None, :] - total
        changes = np.exp(joint).sum(axis=0)
    return np.exp(ahead[:, 1] + behind[:, 1] - total), changes


def train(pages: Iterable[tuple[str, str]], epochs: int = EPOCHS) -> Chain:
    """Fit to (html, main text) pairs by AdaGrad on the log-likelihood."""
    data = []
    for page, text in pages:
        lines = set(text.split("\n"))
        found = blocks(page)
        if found:
            data.append((found, np.array([t in lines for t, _ in found])))
    chain, seen, seen_step = Chain(), {}, np.full((2, 2), 1e-6)
    order = random.Random(SEED)
    for _ in range(epochs):
        order.shuffle(data)
        for found, gold in data:
            p, expected = _marginals(np.array(chain.emission(found)), chain.step)
            slope: dict[str, float] = {}
            for (_, features), d in zip(found, (gold - p).tolist(), strict=True):
                for f in features:
                    slope[f] = slope.get(f, 0.0) + d
            for f, d in slope.items():
                d -= PENALTY * chain.weight.get(f, 0.0)
                seen[f] = seen.get(f, 1e-6) + d * d
                chain.weight[f] = chain.weight.get(f, 0.0) + RATE * d / math.sqrt(seen[f])
            label = gold.astype(int)
            d = np.bincount(2 * label[:-1] + label[1:], minlength=4).reshape(2, 2) - expected
            seen_step += d * d
            chain.step += RATE * d / np.sqrt(seen_step)
    return chain


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> Iterator[tuple[str, str]]:
    """Seeded pages of varied layouts with their main text: the training set.

    A layout is drawn for each page: what holds the article, which furniture surrounds
    it, and which of that stands inside it. Words are made up, so only structure and
    the shape of texts can be learned.
    """
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "an", "sho", "ve", "ru", "pel", "don", "is", "qua", "né", "tzu", "ei"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + rng.choice(".....?!")
    prose = lambda: " ".join(sentence(4, 18) for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))
    named = lambda names: rng.choice(['class="{}"', 'id="{}"', "class={}", 'class="x-{} wide"', 'id="main-{}-1"']).format(rng.choice(names.split()))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    # what islands and formulas hold is drawn apart, so that the rest of a page does not depend on it
    other = random.Random(seed + 1)
    island_words = lambda a, b: " ".join("".join(other.choices(syllables, k=other.randint(1, 4))) for _ in range(other.randint(a, b)))
    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"

    def aside_island() -> str:
        text = island_words(2, 12).capitalize() + other.choice(["", "."])
        return other.choice(["<noscript>{0}</noscript>", "<noscript><div>{0}</div></noscript>", "<select><option>{0}</option><option>{1}</option></select>", "<svg><text>{1}</text></svg>", "<template><p>{0}</p></template>", "<object><p>{0}</p></object>", "<canvas>{0}</canvas>"]).format(text, island_words(1, 3))

    def furniture(kind: str) -> str:
        some = prose() if rng.random() < 0.6 else words(2, 8)
        if kind == "menu":
            links = rng.choice([" ", " | ", "<br>", " &middot; "]).join(link() for _ in range(rng.randint(2, 7)))
            if rng.random() < 0.4:
                return rng.choice([f"<div>{links}</div>", f"<p>{links}</p>", f"<div {named('nav menu topnav links left toolbar')}>{links}</div>", f"<dl><dt>{links}</dl>"])
            return rng.choice([f"<nav>{menu()}</nav>", f"<div {named('nav menu navbar navigation breadcrumb breadcrumbs pagination pager')}>{menu()}</div>", f'<div role="navigation">{menu()}</div>'])
        if kind == "header":
            if rng.random() < 0.3:
                return f"<div {named('head header top site title brand masthead')}>{rng.choice(['<h1>{}</h1>', '<h2>{}</h2>', '{}']).format(words(1, 4))}</div>"
            return rng.choice([f"<header><h1>{words(1, 4)}</h1>{some}</header>", f"<div {named('header masthead banner topbar logo')}>{link()} {words(1, 5)}</div>", f"<header><p>{prose()}</p></header>"])
        if kind == "footer":
            if rng.random() < 0.2:
                return f"<div>{rng.choice(['Copyright', '&copy;', '(c)'])} {rng.randint(1995, 2024)} {words(1, 5)}{rng.choice(['', '. ' + sentence(2, 5)])}</div>"
            return rng.choice([f"<footer>&copy; {words(1, 5)} {some}</footer>", f"<div {named('footer colophon copyright legal bottom')}><p>{some}</p></div>", f"<footer><p>{prose()}</p>{menu()}</footer>"])
        if kind == "side":
            return rng.choice([f"<aside><h3>{words(1, 4)}</h3>{menu()}</aside>", f"<aside><p>{prose()}</p></aside>", f"<div {named('sidebar side related widget recommended trending popular teaser')}><h4>{words(1, 4)}</h4><p>{some}</p></div>"])
        if kind == "ad":
            return f"<div {named('ad ads advert advertisement sponsor sponsored promo promotion banner')}>{rng.choice([some, '<p>' + prose() + '</p>', link()])}</div>"
        if kind == "notice":
            return rng.choice(["<div {}>{}</div>", "<section {}><p>{}</p></section>", "<div {}><p>{}</p><button>" + words(1, 2) + "</button></div>"]).format(named("cookie cookies consent notice gdpr alert popup modal overlay message"), some)
        if kind == "form":
            return rng.choice(["<form {1}><label>{0}</label><input name=q><p>{2}</p></form>", "<div {1}><form><p>{2}</p><input><button>{0}</button></form></div>"]).format(words(1, 4), named("search newsletter subscribe signup login form contact"), some)
        if kind == "share":
            return f"<div {named('share social sharing tags meta byline toolbar')}>{rng.choice([link() + link(), words(1, 4)])}</div>"
        remarks = range(rng.randint(1, 4))
        one = rng.choice(["<div class=comment><b>{0}</b><p>{1}</p></div>", "<li><p>{1}</p></li>", "<article class=\"comment\"><h4>{0}</h4><p>{1}</p></article>", "<p>{1}</p>"])
        inner = "".join(one.format(words(1, 2), prose()) for _ in remarks)
        return rng.choice(["<section {}><h3>{}</h3>{}</section>", "<div {}><h2>{}</h2>{}</div>", "<ol {}><li>{}</li>{}</ol>"]).format(named("comments comment replies discussion responses disqus respond reader-comments"), words(1, 3), inner)

    kinds = ["menu", "header", "footer", "side", "ad", "notice", "form", "share", "comments"]
    holders = ["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", "<div {n}>{}</div>", "<div {n}>{}</div>", "<section {n}>{}</section>", "<div role=main>{}</div>", "<article {n}>{}</article>", "<table><tr><td {n}>{}</td></tr></table>", "<div>{}</div>"]
    for _ in range(n):
        gold: list[str] = []
        parts = []

        def put(tag: str, text: str, gold: list[str] = gold, parts: list[str] = parts) -> None:
            gold.append(text)
            shown = text.replace("&", "&amp;")
            if rng.random() < 0.3:
                shown = f"<b>{shown}" + rng.choice(["</b>", "", "<br>"])
            elif rng.random() < 0.2:
                shown += f' <a href="#">{(more := word())}</a>'
                gold[-1] += " " + more
            parts.append(f"<{tag}>{shown}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.8 else ""))

        if rng.random() < 0.8:
            put("h1", words(1, 12).capitalize())
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 10])):
            if rng.random() < 0.12:
                put(rng.choice(["h2", "h3"]), words(1, 6).capitalize())
            if rng.random() < 0.08:
                for _ in range(rng.randint(2, 4)):
                    put("li", sentence(3, 15))
            elif rng.random() < 0.05:
                put("blockquote", prose())
            elif rng.random() < 0.06:
                put("div", prose())
            else:
                put("p", prose() if rng.random() < 0.85 else sentence(1, 6))
            if other.random() < 0.06:
                gold.append(" ".join(island_words(4, 18).capitalize() + "." for _ in range(other.randint(1, 4))))
                parts.append(other.choice(["<noscript><p>{}</p></noscript>", "<object data=x><p>{}</p></object>", "<canvas>{}</canvas>"]).format(gold[-1]))
            if rng.random() < 0.15:
                parts.append(furniture(rng.choice(["ad", "ad", "notice", "share", "form", "side"])))
        if rng.random() < 0.15:
            parts.append(furniture("comments"))
        holder = rng.choice(holders).replace("{n}", named("content article post entry story body text main article-body post-content entry-content"))
        before = [furniture(k) for k in rng.sample(["menu", "header", "ad", "notice", "side", "form"], rng.randint(0, 4))]
        after = [furniture(k) for k in rng.sample(kinds, rng.randint(0, 5))] + ([furniture("footer")] if rng.random() < 0.8 else [])
        before += [aside_island()] if other.random() < 0.2 else []
        after += [aside_island()] if other.random() < 0.1 else []
        article = "".join(parts)
        if rng.random() < 0.08:  # a table of the page's parts
            cell = lambda x: f"<td {named('left right top bottom nav side menu footer cell')}>{x}</td>" if rng.random() < 0.6 else f"<td>{x}</td>"
            own = f"<td {named('content main text body article')}>{article}</td>" if rng.random() < 0.7 else f"<td>{article}</td>"
            rows = ["".join(map(cell, before[:1])), "".join([*map(cell, before[1:]), own, *map(cell, after[:1])]), *map(cell, after[1:])]
            body = "<table>" + "".join(f"<tr>{r}</tr>" for r in rows if r) + "</table>"
        else:
            if rng.random() < 0.05:  # text that only line breaks part, in an element without a name
                gold.append(" ".join(more := [prose() for _ in range(rng.randint(1, 3))]))
                article += f"<div>{rng.choice(['<br>', '<br><br>']).join(more)}</div>"
            body = "\n".join([*before, holder.replace("{}", article), *after])
        yield f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title></head><body>{body}</body></html>", "\n".join(gold)


def main_text(pages: DataFrame, chain: Chain) -> DataFrame:
    """(page_id, url, text, n_chars) of every page row, from the whole html.

    Null and empty html, and pages without main text, have an empty text. Cut-off
    pages keep what was read; repeated rows are extracted apart.
    """
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [chain.extract(page or "") for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), train(labelled_pages()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_crf_main_text": op5_crf_main_text}
#: A trained model: tested by held-out accuracy and against exhaustive decoding instead.
SQL: dict[str, str] = {}
