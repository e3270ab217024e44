"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A tolerant, forward-only tokenizer turns a page into leaf blocks: runs of text between
block-level tags, each with the features of its open ancestors. A tag ends at the first
`>` outside quotes; from an attribute whose quote never closes on, at the first `>`. Every
character is read a bounded number of times and an open element keeps a mask of fixed size
over its ancestors, so time and memory grow in proportion to the page, however broken.
Ancestor tags, the words of their class, id and role, and features of the text feed a
two-label CRF (content or not). It is trained by gradient ascent on labelled pages that
`labelled_pages` writes from a seed, and decoded by Viterbi.
Scripts, styles, other raw elements and comments are never text; of raw elements without an
end tag only the open tag is skipped (scripts, styles and titles run to the end of the page).

Null html: empty text. Null ids and repeated rows are handled like any other row. An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._util import slices, table

#: HTML elements whose content is no text, that never close, and that stay within a block.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "option", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
HINTS = ("nav", "menu", "header", "footer", "sidebar", "aside", "notice", "cookie", "banner", "ad", "ads", "advert", "promo", "sponsor", "form", "comment", "comments", "reply", "share", "social", "related", "breadcrumb", "widget", "consent", "popup", "subscribe", "newsletter", "login", "search", "article", "content", "main", "post", "entry", "story", "body", "text", "caption", "note")
TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "p", "div", "table", "td", "h1", "h2", "h3", "h4", "blockquote", "pre", "figure", "figcaption", "dl", "fieldset", "body", "head")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ZEROS = re.compile(r"&#([xX]?)0{7,}+")
_LARGE = re.compile(r"&#(?:[xX]0*+[0-9a-fA-F]{7,}+|0*+[0-9]{8,}+);?")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
NAMES = [f"tag:{t}" for t in TAGS] + [f"hint:{h}" for h in HINTS] + ["bias", "linked", "half", "short", "medium", "long", "stop", "parent:p", "first", "in:other"]
AT = {n: i for i, n in enumerate(NAMES)}
BIT = {n: 1 << i for i, n in enumerate(NAMES)}
_INSIDE = 1 << len(NAMES)  # some ancestor is the article


@functools.lru_cache(4096)
def _own(tag: str, attributes: str) -> int:
    """Mask of an element by itself."""
    words = re.findall(r"[a-z]+", " ".join("".join(g) for g in _ATTR.findall(attributes)).lower()) if attributes else ()
    out = BIT.get(f"tag:{tag}", 0) | (_INSIDE if tag in ("article", "main") else 0)
    for w in set(words):
        out |= BIT.get(f"hint:{w}", 0)
    return out


def blocks(page: str):
    """[(text, mask of its ancestors, share of linked characters)] in page order."""
    out, parts = [], []
    masks, tags, open_ = [0], [""], Counter()  # open elements, under the root
    linked = total = links = at = 0
    last, pattern, unclosed = page.rfind(">"), _TAG, set()
    while at < len(page):
        start = page.find("<", at)
        if start < 0 or start > last:
            start = len(page)
        if start > at:
            parts.append(page[at:start])
            total += start - at
            if links:
                linked += start - at
            at = start
            if at == len(page):
                break
        m = pattern.match(page, at)
        if not m:
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                at = stop + 3 if stop >= 0 else len(page)
                continue
            if page.startswith(("<!", "<?"), at):
                at = page.find(">", at) + 1
                continue
            if pattern is _TAG and (m := _LOOSE.match(page, at)):
                pattern = _LOOSE  # a quote never closes: from here on a tag ends at the first `>`
            else:
                parts.append("<")
                total += 1
                at += 1
                continue
        end, tag, attributes, at = m[1], m[2].lower(), m[3], m.end()
        if tag in INLINE:
            if tag == "a":
                links = 0 if end else 1
            continue
        if tag in RAW:
            if not end and not (tag == "svg" and attributes.endswith("/")):
                stop = None if tag in unclosed else _raw_end(tag).search(page, at)
                if stop:
                    at = stop.end()
                elif tag in ("script", "style", "title"):
                    at = len(page)
                else:
                    unclosed.add(tag)
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if parts:
            text = clean("".join(parts))
            if text:
                out.append((text, masks[-1] | _leaf(tags[-1]), linked / max(1, total)))
            parts = []
        linked = total = links = 0
        if tag in VOID:
            continue
        if end:
            if open_[tag] and (tag != "p" or tags[-1] == "p"):
                while True:
                    masks.pop()
                    gone = tags.pop()
                    open_[gone] -= 1
                    if gone == tag:
                        break
        else:
            while tags[-1] == "p" or tag == tags[-1] == "li":
                masks.pop()
                open_[tags.pop()] -= 1
            masks.append(masks[-1] | _own(tag, attributes if len(attributes) < 1024 else _hints(attributes)))
            tags.append(tag)
            open_[tag] += 1
    text = clean("".join(parts))
    if text:
        out.append((text, masks[-1] | _leaf(tags[-1]), linked / max(1, total)))
    return out


@functools.lru_cache(64)
def _raw_end(tag: str):
    return re.compile(rf"</{re.escape(tag)}\s*+>", re.I)


def _hints(attributes: str) -> str:
    """Very long attributes in short, so that the cache stays small: the known words of class, id and role."""
    words = set(re.findall(r"[a-z]+", " ".join("".join(g) for g in _ATTR.findall(attributes)).lower()))
    return f'class="{" ".join(sorted(words & set(HINTS)))}"'


def _leaf(tag: str) -> int:
    return BIT["parent:p"] if tag == "p" else 0


def clean(text: str) -> str:
    """Character references decoded, white space to one blank; numbers beyond any character are U+FFFD."""
    if "&" in text:
        if "&#" in text:
            text = _LARGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
        text = html.unescape(text)
    return _SPACE.sub(" ", text).strip()


@functools.lru_cache(20_000)
def _columns(mask: int) -> tuple[int, ...]:
    mask |= BIT["bias"] | (0 if mask & _INSIDE else BIT["in:other"])
    return tuple(i for i in range(len(NAMES)) if mask >> i & 1)


def features(found) -> np.ndarray:
    x = np.zeros((len(found), len(NAMES)), np.float32)
    for i, (text, mask, linked) in enumerate(found):
        x[i, list(_columns(mask))] = 1
        n = text.count(" ") + 1
        x[i, AT["linked"]], x[i, AT["half"]] = linked, linked > 0.5
        x[i, AT["short" if n < 5 else "medium" if n < 20 else "long"]] = 1
        x[i, AT["stop"]] = text[-1] in ".!?"
        x[i, AT["first"]] = i == 0
    return x


class CRF:
    """Two labels; weights (features, 2) and transitions (2, 2)."""

    def __init__(self):
        self.w, self.t = np.zeros((len(NAMES), 2)), np.zeros((2, 2))

    def scores(self, found) -> list[tuple[float, float]]:
        """features(found) @ w without the matrix: ancestors are scored once per mask."""
        w, known, out = self.w.tolist(), {}, []
        linked_, half, stop, first = (w[AT[n]] for n in ("linked", "half", "stop", "first"))
        sizes = [w[AT[n]] for n in ("short", "medium", "long")]
        for text, mask, linked in found:
            s = known.get(mask)
            if s is None:
                s = known[mask] = tuple(self.w[list(_columns(mask))].sum(axis=0).tolist())
            n = text.count(" ")
            a, b = s
            z = sizes[0 if n < 4 else 1 if n < 19 else 2]
            a, b = a + z[0], b + z[1]
            if linked:
                a, b = a + linked * linked_[0], b + linked * linked_[1]
                if linked > 0.5:
                    a, b = a + half[0], b + half[1]
            if text[-1] in ".!?":
                a, b = a + stop[0], b + stop[1]
            out.append((a, b))
        if out:
            out[0] = (out[0][0] + first[0], out[0][1] + first[1])
        return out

    def viterbi(self, x: np.ndarray) -> list[int]:
        return self.decode((x @ self.w).tolist())

    def decode(self, s: list) -> list[int]:
        """The best labels, given the scores of both labels for each block."""
        if not s:
            return []
        (t00, t01), (t10, t11) = self.t.tolist()
        back, (a, b) = [], s[0]
        for u, v in s[1:]:
            from0, from1 = b + t10 > a + t00, b + t11 > a + t01
            a, b = u + (b + t10 if from0 else a + t00), v + (b + t11 if from1 else a + t01)
            back.append((from0, from1))
        out = [int(b > a)]
        for f in reversed(back):
            out.append(int(f[out[-1]]))
        return out[::-1]

    def gradient(self, x, y):
        s, n = x @ self.w, len(y)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = s[0]
        for i in range(1, n):
            f[i] = s[i] + np.logaddexp.reduce(f[i - 1][:, None] + self.t, axis=0)
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp.reduce(self.t + s[i + 1] + b[i + 1], axis=1)
        z = np.logaddexp.reduce(f[-1])
        p = np.exp(f + b - z)
        gw = x.T @ (np.eye(2)[y] - p)
        gt = np.zeros((2, 2))
        for i in range(1, n):
            gt -= np.exp(f[i - 1][:, None] + self.t + s[i] + b[i] - z)
            gt[y[i - 1], y[i]] += 1
        return gw, gt

    def fit(self, pages, rounds: int = 12, rate: float = 0.3, reg: float = 1e-3):
        gw2, gt2 = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        for _ in range(rounds):
            for x, y in pages:
                gw, gt = self.gradient(x, y)
                gw -= reg * self.w
                gw2 += gw**2
                gt2 += gt**2
                self.w += rate * gw / np.sqrt(gw2)
                self.t += rate * gt / np.sqrt(gt2)
        return self


def labelled_pages(n: int = 160, seed: int = 3):
    """Pages with a label for each block, written from a seed in many layouts; content words start with `k`."""
    r = random.Random(seed)

    def words(lo, hi, mark="z"):
        return " ".join(mark + "".join(r.choice("abcdeinorst") for _ in range(r.randint(1, 8))) for _ in range(r.randint(lo, hi))) + r.choice([".", "", "!"])

    def links(k):
        return "<ul>" + "".join(f"<li><a href='/{i}'>{words(1, 3)}</a></li>" for i in range(k)) + "</ul>"

    def noise():
        kind = r.randrange(9)
        text = words(2, 25)
        return [f"<nav>{links(r.randint(2, 8))}</nav>", f"<div class='{r.choice(['ad', 'ads', 'advert', 'sponsor', 'promo banner'])}'>{text}</div>",
                f"<aside class='{r.choice(['sidebar', 'related', 'widget'])}'><h3>{words(1, 4)}</h3><p>{text}</p>{links(2)}</aside>",
                f"<div class='{r.choice(['cookie notice', 'consent banner', 'notice', 'popup'])}'><p>{text}</p></div>",
                f"<form><label>{words(1, 3)}</label><p>{text}</p><input></form>", f"<div id='{r.choice(['menu', 'nav', 'breadcrumb'])}'>{links(3)}</div>",
                f"<section class='{r.choice(['comments', 'comment', 'reply'])}'>" + "".join(f"<div class='comment'><p>{words(3, 30)}</p></div>" for _ in range(r.randint(1, 4))) + "</section>",
                f"<div class='{r.choice(['share', 'social', 'newsletter', 'subscribe'])}'>{text}</div>", "<script>var a='</p>';</script>"][kind]

    def body():
        out = [f"<h1>{words(2, 9, 'k')}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 8)):
            out.append(r.choice([lambda: f"<p>{words(1, 60, 'k')}</p>", lambda: f"<p><b>{words(1, 12, 'k')}<br>", lambda: f"<h2>{words(1, 5, 'k')}</h2>",
                                 lambda: "<ul>" + "".join(f"<li>{words(1, 12, 'k')}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote><p>{words(4, 30, 'k')}</p></blockquote>",
                                 lambda: f"<p>{words(4, 20, 'k')} <a href='#'>{words(1, 3, 'k')}</a> {words(4, 20, 'k')}</p>"])())
            if r.random() < 0.12:
                out.append(noise())
        return "".join(out)

    pages = []
    for _ in range(n):
        open_, close = r.choice([("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div id='main'><div class='post entry'>", "</div></div>"), ("<article class='story'>", "</article>")])
        head = r.choice([f"<header><div>{words(1, 4)}</div>{links(4)}</header>", f"<nav>{links(6)}</nav>", f"<div class='header'>{words(2, 6)}</div>", ""])
        foot = r.choice([f"<footer>&copy; {words(1, 12)}</footer>", f"<footer><p>{words(3, 20)}</p>{links(3)}</footer>", f"<div class='footer'>{words(2, 9)}</div>"])
        page = f"<html><head><title>{words(2, 5)}</title></head><body>{head}{''.join(noise() for _ in range(r.randint(0, 3)))}{open_}{body()}{close}{''.join(noise() for _ in range(r.randint(0, 2)))}{foot}</body></html>"
        found = blocks(page)
        pages.append((features(found), np.array([int(t.startswith("k")) for t, _, _ in found])))
    return [p for p in pages if len(p[1])]


@functools.lru_cache(1)
def trained() -> CRF:
    return CRF().fit(labelled_pages())


def main_text(page: str | None, model: CRF) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    return "\n".join(t for (t, _, _), y in zip(found, model.decode(model.scores(found))) if y)


def extract(pages: DataFrame, model: CRF | None = None) -> DataFrame:
    """(page_id, url, text, n_chars); the model is a few kilobytes and travels with the task."""
    model = model or trained()

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(h, model) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_htmltext(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


SQL4 = r"""with a as (select page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) h from pages),
b as (select page_id, url, unnest(string_split_regex(h, '</?(?:p|h1)>')) t, generate_subscripts(string_split_regex(h, '</?(?:p|h1)>'), 1) i from a),
c as (select page_id, url, i, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(t, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) t from b),
d as (select page_id, url, string_agg(t, chr(10) order by i) filter (where t <> '') t from c group by 1, 2)
select page_id, url, coalesce(t, '') as text, length(coalesce(t, ''))::bigint as n_chars from d"""
QUERIES, SQL = {"op4_htmltext": op4_htmltext}, {"op4_htmltext": SQL4}
