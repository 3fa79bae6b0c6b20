"""Fits the model of ``html_extract`` on invented pages of known make-up and writes its file.

    python -m millrace.llm.main_text_model

``PAGES`` pages are drawn from a fixed seed.  The words of attributes get weights by
how often elements that have them lie in main text, and so do tags' names; the trees see weights learned
from the other half of the pages only, and every fourth element's words are hidden
from them, so that they do not lean on names alone.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import numpy as np

from millrace.llm.dom import Node, attribute_words, features, parse, walk, weights
from millrace.llm.html_extract import MODEL, MainText
from millrace.llm.trees import BoostedTrees

PAGES, SEED = 3000, 11
#: Share of elements whose words the trees do not see, and how rare a word may be.
HIDDEN, LEAST = 0.25, 4
#: A word's weight at most: no name alone decides.
CLIP = 3.0

#: Names in use on the public web, by what they are mostly given to; pages draw from them, and often a neutral or no name at all.
NAMES = {
    "article": "article content post entry-content story-body main post-body article-body articleBody entry hentry blog-post post-content single-post story main-content page-content text body-copy richtext markdown-body mw-parser-output node__content field--name-body td-post-content prose documentation lesson recipe".split(),
    "menu": "nav navbar main-menu menu breadcrumbs breadcrumb top-links site-nav navigation nav-tabs pagination pager toc-nav skip-links submenu dropdown-menu mega-menu hamburger navigation__list".split(),
    "header": "header masthead site-head topbar site-header page-header logo-bar hero-top brand utility-bar app-header".split(),
    "footer": "footer site-footer legal bottom colophon copyright footer-links page-footer imprint contentinfo disclaimer".split(),
    "side": "sidebar related widget right-rail popular aside secondary trending recommended more-stories widget-area teaser-list most-read tag-cloud archives author-box also-like read-more next-prev".split(),
    "advert": "ad ads advert sponsored promo-box ad-slot banner adsbygoogle ad-container dfp-ad advertisement sponsor native-ad outbrain taboola commercial promo".split(),
    "notice": "cookie-banner consent notice newsletter popup alert gdpr cookie-consent modal overlay paywall subscribe-box signup-prompt app-banner toast announcement".split(),
    "form": "search-form login signup contact-form searchform subscribe-form form-group poll feedback rating login-box donate".split(),
    "talk": "comments comment-list discussion replies comment-thread disqus_thread respond user-comments reviews commentlist reactions feedback-list".split(),
    "share": "share social follow-us sharedaddy social-links share-buttons addthis post-meta-share like-box".split(),
}
#: What any name may begin or end with.
BEFORE = "site- page- c- o- md- sc- main- primary- entry- post- the- block- app- l- global- article- content- left- top-".split()
AFTER = "-wrap -inner -area -list -item -block -box -container -body -section -main -content -group -header -title -1".split()
PLAIN = "row col-md-8 container wrap inner clearfix block module box section grid column layout wrapper page css-1x2y panel card unit group region".split()

_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu an er in on ul str pl ch tion ment".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.randint(3, 18)).capitalize() + r.choice(".....!?") for _ in range(n))


def _item(r: random.Random) -> str:
    return _words(r, r.randint(1, 4)).capitalize()


def _list(r: random.Random, n: int, linked: float) -> str:
    rows = [f'<li><a href="/{k}">{_item(r)}</a></li>' if r.random() < linked else f"<li>{_item(r)}</li>" for k in range(n)]
    tag = r.choice(["ul", "ul", "ol"])
    return f"<{tag}>{''.join(rows)}</{tag}>"


def _varied(r: random.Random, name: str) -> str:
    if name and r.random() < 0.3:
        name = r.choice(BEFORE) + name
    return name + r.choice(AFTER) if name and r.random() < 0.25 else name


def _plain(r: random.Random) -> str:
    """A start tag of a wrapper, which says nothing."""
    name = _varied(r, r.choice(PLAIN)) if r.random() < 0.6 else _varied(r, r.choice(["content", "main", "post", "site", "page", "single", "home"]))
    return f'<div class="{name}">' if r.random() < 0.7 else "<div>"


def _named(r: random.Random, tag: str, kind: str, rate: float = 0.7) -> tuple[str, str]:
    """Start and end of an element: named after its kind, named plainly, or not named; sometimes wrapped."""
    form = r.random()
    name = r.choice(NAMES[kind]) if form < rate else r.choice(PLAIN) if form < rate + 0.15 else ""
    name = _varied(r, name)
    if name and r.random() < 0.25:
        name += " " + r.choice(PLAIN)
    attr = f' {r.choice(["class", "class", "id"])}="{name}"' if name else ""
    if r.random() < 0.1:
        attr += f' data-x="{_words(r, 1)}"'
    tag = tag if r.random() < 0.5 else "div"
    a, b = f"<{tag}{attr}>", f"</{tag}>"
    if r.random() < 0.2:
        plain = _plain(r)
        a, b = (f"{plain}{a}", f"{b}</div>") if r.random() < 0.5 else (f"{a}{plain}", f"</div>{b}")
    return a, b


def _teasers(r: random.Random) -> str:
    rows = [f'<div class="{r.choice(["teaser", "card", "item", ""])}"><a href="/x">{_words(r, r.randint(2, 7))}</a><p>{_sentences(r, 1)}</p></div>' for _ in range(r.randint(2, 5))]
    return "".join(rows)


def _boilerplate(r: random.Random, kind: str) -> str:
    if kind == "menu":
        a, b = _named(r, "nav", "menu")
        links = " | ".join(f'<a href="/{k}">{_item(r)}</a>' for k in range(r.randint(2, 9)))
        return a + (_list(r, r.randint(3, 12), 0.95) if r.random() < 0.75 else links) + b
    if kind == "header":
        a, b = _named(r, "header", "header")
        return f'{a}<a href="/" class="{r.choice(["logo", "brand", "home"])}">{_item(r)}</a>{r.choice(["", f"<p>{_words(r, r.randint(2, 8))}</p>", f"<h2>{_item(r)}</h2>", f"<h1>{_item(r)}</h1>"])}{b}'
    if kind == "footer":
        a, b = _named(r, "footer", "footer")
        return f"{a}{r.choice(['', '<p>'])}{r.choice(['&copy; ', '', 'Copyright '])}{r.randint(1990, 2030)} {_item(r)} &middot; {_sentences(r, r.randint(1, 3))}{r.choice(['', _list(r, r.randint(2, 6), 1)])}{b}"
    if kind == "side":
        a, b = _named(r, "aside", "side")
        return f"{a}<h3>{_item(r)}</h3>{r.choice([_list(r, r.randint(3, 9), 0.9), f'<p>{_sentences(r, r.randint(1, 3))}</p>', f'<p>{_sentences(r, 1)}</p>' + _list(r, 4, 0.9), _teasers(r)])}{b}"
    if kind == "advert":
        a, b = _named(r, "div", "advert", 0.85)
        return f"{a}{r.choice([_sentences(r, r.randint(1, 3)), f'<p>{_sentences(r, r.randint(1, 2))}</p>', f'<a href=x>{_words(r, 5)}</a>'])}{b}"
    if kind == "notice":
        a, b = _named(r, "div", "notice", 0.85)
        return f"{a}<p>{_sentences(r, r.randint(1, 3))}</p>{r.choice(['', f'<button>{_item(r)}</button>', f'<a href=x>{_item(r)}</a>'])}{b}"
    if kind == "form":
        a, b = _named(r, "form", "form")
        return f"{a}<form><label>{_item(r)}</label><input type=text><button>{_item(r)}</button>{r.choice(['', f'<p>{_sentences(r, 1)}</p>', f'<select><option>{_item(r)}<option>{_item(r)}</select>'])}</form>{b}"
    if kind == "talk":
        a, b = _named(r, "section", "talk", 0.9)
        wrap = r.choice(["div", "li", "article"])
        rows = "".join(f'<{wrap} class="{r.choice(["comment", "reply", "comment-body", "review"])}"><b>{_item(r)}</b><p>{_sentences(r, r.randint(1, 5))}</p></{wrap}>' for _ in range(r.randint(1, 8)))
        return f"{a}<h3>{_item(r)}</h3>{'<ol>' + rows + '</ol>' if wrap == 'li' else rows}{b}"
    a, b = _named(r, "div", "share", 0.9)
    return a + _list(r, r.randint(2, 5), 1.0) + b


def _piece(r: random.Random) -> str:
    """A block of main text, of the kinds that articles, manuals and old pages are made of."""
    text = _sentences(r, r.choice([1, 1, 2, 4, 8]))
    form = r.random()
    if form < 0.6:
        return f"<p>{text}</p>" if r.random() < 0.8 else f"<p><b>{text}<br>"
    if form < 0.66:
        n = r.randint(2, 4)
        return f"<h{n}>{_item(r)}</h{n}><p>{text}"
    if form < 0.72:
        return _list(r, r.randint(2, 6), 0.1) if r.random() < 0.5 else "<ul>" + "".join(f"<li>{_sentences(r, 1)}" for _ in range(r.randint(2, 6))) + "</ul>"
    if form < 0.77:
        return f"<blockquote>{text}</blockquote>"
    if form < 0.83:
        return f'<p>{text} <a href="#">{_words(r, 3)}</a> <em>{_words(r, 2)}</em> {_sentences(r, 1)}</p>'
    if form < 0.87:
        return "<table>" + "".join(f"<tr><td>{_words(r, 3)}</td><td>{_words(r, 6)}</td></tr>" for _ in range(r.randint(1, 6))) + "</table>"
    if form < 0.9:
        return f"<pre><code>{_words(r, 8)}\n{_words(r, 6)}</code></pre>"
    if form < 0.93:
        return f'<figure><img src=x><figcaption>{_sentences(r, 1)}</figcaption></figure>'
    if form < 0.96:
        return f"<dl><dt>{_item(r)}<dd>{text}</dl>"
    return f'<div class="{r.choice(PLAIN)}"><p>{text}</p></div>' if r.random() < 0.5 else f"<div>{text}</div>"


def _article(r: random.Random, inside: str) -> str:
    n = min(int(r.paretovariate(0.7)) + r.choice([0, 0, 1, 4]), 200)
    if r.random() < 0.08:  # lines parted by breaks alone
        body = ["<br><br>".join(_sentences(r, r.randint(1, 5)) for _ in range(n))]
    else:
        body = [_piece(r) for _ in range(n)]
    if inside:
        body.insert(r.randint(0, len(body)), f"<!--out-->{inside}<!--in-->")
    a, b = _named(r, r.choice(["article", "article", "main", "section", "div"]), "article")
    if r.random() < 0.2:
        a, b = f"{a}<header>{_words(r, 5)}</header>", b
    head = f"<h1>{_words(r, r.randint(1, 10))}</h1>" if r.random() < 0.8 else ""
    return f"{a}{head}{''.join(body)}{b}"


def synthetic_page(r: random.Random) -> tuple[str, list[bool]]:
    """A page and, for every element as ``walk`` lists them, whether it lies in the main text.

    Main text is marked by comments, which the labels are read from and which the
    parser drops.
    """
    pieces = [k for k in ("header", "menu", "notice", "advert", "form", "share", "side") if r.random() < 0.45]
    after = [k for k in ("share", "advert", "side", "talk", "form", "menu", "notice", "footer") if r.random() < 0.45]
    inside = _boilerplate(r, r.choice(["advert", "advert", "share", "side", "form", "notice"])) if r.random() < 0.45 else ""
    article = f"<!--in-->{_article(r, inside)}<!--out-->"
    before_html, after_html = "".join(_boilerplate(r, k) for k in pieces), "".join(_boilerplate(r, k) for k in after)
    layout = r.random()
    if layout < 0.1:  # columns of a table
        inner = f"<table><tr><td>{before_html}</td><td>{article}</td></tr><tr><td colspan=2>{after_html}</td></tr></table>"
    elif layout < 0.3:  # article and side matter in one column
        inner = f"{before_html}{_plain(r)}{article}{after_html}</div>"
    else:
        depth = r.choice([0, 0, 1, 2])
        inner = "".join(_plain(r) for _ in range(depth)) + before_html + article + after_html + "</div>" * depth
    body = f' class="{_varied(r, r.choice(PLAIN))} {r.choice(["post", "home", "single", "page-template", "dark"])}"' if r.random() < 0.4 else ""
    page = f"<html><head><title>{_item(r)}</title></head><body{body}>{inner}</body></html>"
    return page, _labels(page)


def _labels(page: str) -> list[bool]:
    """Walks the page in two readings: what is between in and out marks is main text."""
    parts = page.replace("<!--in-->", "\x01").replace("<!--out-->", "\x02")
    inside, out = False, []
    stack: list = [parse(parts)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            last = max(x.rfind("\x01"), x.rfind("\x02"))
            inside = x[last] == "\x01" if last >= 0 else inside
        else:
            out.append(inside)
            stack.extend(reversed(x.parts))
    return out


def word_weights(pages: list[tuple[list[Node], list[bool]]]) -> dict[str, float]:
    """Log-odds of main text, against all elements', for words that several elements have; shrunk towards 0."""
    held: tuple[Counter, Counter] = Counter(), Counter()
    for nodes, label in pages:
        for x, y in zip(nodes, label):
            held[y].update({f"<{x.tag}>", *attribute_words(x.attrs)})
    share = sum(held[1].values()) / (sum(held[0].values()) + sum(held[1].values()))
    prior = math.log(share / (1 - share))
    logit = lambda w: math.log((held[1][w] + 2 * share) / (held[0][w] + 2 * (1 - share)))
    return {w: round(min(CLIP, max(-CLIP, logit(w) - prior)), 4) for w in sorted({*held[0], *held[1]}) if held[0][w] + held[1][w] >= LEAST}


def fit(pages: int = PAGES, seed: int = SEED) -> MainText:
    r = random.Random(seed)
    made = []
    for _ in range(pages):
        page, label = synthetic_page(r)
        made.append((walk(parse(page)), label))
    halves = made[::2], made[1::2]
    learned = word_weights(halves[1]), word_weights(halves[0])
    xs, ys, ws = [], [], []
    for half, words in zip(halves, learned):
        for nodes, label in half:
            y = np.array(label, dtype=float)
            number = {id(x): k for k, x in enumerate(nodes)}
            pure = np.ones(len(nodes), dtype=bool)
            for k in range(len(nodes) - 1, 0, -1):  # elements with both below them teach nothing
                p = number[id(nodes[k].parent)]
                if not pure[k] or y[k] != y[p]:
                    pure[p] = False
            xs.append(np.concatenate(list(features(nodes, words, lambda: r.random() < HIDDEN)))[pure])
            ys.append(y[pure])
            ws.append(1 + np.log1p(weights(nodes))[pure])
    trees = BoostedTrees(rounds=120).fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))
    return MainText(trees, word_weights(made))


def main() -> None:
    model = fit()
    MODEL.write_text(json.dumps({"trees": model.trees.saved(), "words": model.words}, separators=(",", ":")) + "\n", encoding="utf-8")


if __name__ == "__main__":
    main()
