"""Labelled pages for training the page extractor: layouts whose parts are known to be article or not.

Each page is a list of (html, whether it is of the article) parts. A third have an article element; the others
tell it by names of plain elements, by table cells, or by shape alone. Words are drawn at random, so only
structure and shape can be learned.
"""

from __future__ import annotations

import random

PAGES = 600


def _words(rng: random.Random, low: int, high: int) -> str:
    one = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiouéö") for _ in range(rng.randint(1, 4)))
    text = [one() for _ in range(rng.randint(low, high))]
    for i in range(rng.randint(6, 12), len(text), rng.randint(7, 14)):
        text[i - 1] += rng.choice([".", ",", ".", "."])
    return " ".join(text).capitalize()


def _sentence(rng: random.Random, low: int, high: int) -> str:
    return _words(rng, low, high) + rng.choice([".", ".", ".", "!", "?", ""])


def _links(rng: random.Random, n: int, item: str = "li") -> str:
    return "".join(f'<{item}><a href="/{k}">{_words(rng, 1, 4)}</a></{item}>' for k in range(n))


def _article(rng: random.Random) -> str:
    """The inside of an article: headings, paragraphs of any length, lists, quotes, tables, captions."""
    out = []
    if rng.random() < 0.25:  # hardly any text
        line = _sentence(rng, 1, 4)
        out.append(f"<h1>{line}</h1>" + rng.choice(["<p><b>{}<br>", "<p>{}</p>", "<p>{}", ""]).format(line))
        return "".join(out) + "".join(f"<p>{_sentence(rng, 1, 4)}</p>" for _ in range(rng.choice([0, 0, 1, 2])))
    if rng.random() < 0.8:
        out.append(f"<h1>{_words(rng, 3, 12)}</h1>")
    for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
        kind = rng.random()
        if kind < 0.66:
            low = rng.choice([1, 3, 8, 20, 40])
            out.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{} <a href='/x'>more here</a> {}</p>"]).replace("{}", _sentence(rng, low, low * 3), 1).replace("{}", _words(rng, 2, 20)))
        elif kind < 0.76:
            out.append(f"<h{rng.randint(2, 4)}>{_words(rng, 1, 7)}</h2>")
        elif kind < 0.84:
            out.append("<ul>" + "".join(f"<li>{_sentence(rng, 1, 15)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.89:
            out.append(f"<blockquote><p>{_sentence(rng, 4, 40)}</p></blockquote>")
        elif kind < 0.93:
            out.append("<table>" + "".join(f"<tr><td>{_words(rng, 1, 3)}</td><td>{rng.randint(1, 900)}</td></tr>" for _ in range(2)) + "</table>")
        elif kind < 0.96:
            out.append(f"<figure><img src=x><figcaption>{_words(rng, 2, 12)}</figcaption></figure>")
        else:
            out.append(f"<pre>{_words(rng, 3, 20)}</pre>")
    return "\n".join(out) if rng.random() < 0.3 else "".join(out)


def _noise(rng: random.Random, kind: str) -> str:
    p = lambda low, high: f"<p>{_sentence(rng, low, high)}</p>"
    if kind == "nav":
        return rng.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="main-nav" class="navbar">{}</ul>', '<div class="breadcrumbs">{}</div>', '<nav class="pagination">{}</nav>']).format(_links(rng, rng.randint(2, 9)))
    if kind == "header":
        return rng.choice(["<header>{}</header>", '<div id="header">{}</div>', '<div class="site-header masthead">{}</div>', '<header class="top">{}</header>']).format(rng.choice(["<h1>{}</h1>", "<p>{}</p>", "<a href='/'>{}</a>", "<h2>{}</h2><p>x</p>"]).format(_words(rng, 1, 8)))
    if kind == "footer":
        return rng.choice(["<footer>{}</footer>", '<div id="footer">{}</div>', '<div class="site-footer">{}</div>', '<footer><p>{}</p></footer>']).format(rng.choice(["&copy; ", "", "Copyright "]) + _words(rng, 2, 25) + rng.choice(["", " &middot; " + _words(rng, 2, 12), "<p>" + _words(rng, 3, 14) + "</p>"]))
    if kind == "sidebar":
        return rng.choice(["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<aside id="secondary" class="widget-area">{}</aside>', '<div class="related-posts">{}</div>', '<section class="widget recommended">{}</section>']).format(f"<h3>{_words(rng, 1, 3)}</h3>" + rng.choice(["<ul>" + _links(rng, rng.randint(2, 6)) + "</ul>", p(4, 40), p(4, 12) + "<ul>" + _links(rng, 3) + "</ul>"]))
    if kind == "ad":
        more = "".join(rng.choice("bcdfgklmnprstvx") for _ in range(rng.randint(1, 3)))
        if rng.random() < 0.4:  # a name that holds the word
            own = rng.choice([f"{more}ads", f"ads{more}", f"{more}-ad", f"ad-{more}", f"{more}advert", f"sponsor{more}", f"{more}promo"])
            return rng.choice(["<div class='{}'>{}</div>", "<div id='{}'>{}</div>", "<section class='{}'><p>{}</p></section>", "<div class='{}'><p>{}</p></div>"]).format(own, _sentence(rng, 2, 40))
        return rng.choice(['<div class="ad">{}</div>', '<div class="ads-box">{}</div>', '<div id="advert-top">{}</div>', '<div class="sponsored">{}</div>', '<section class="promo banner">{}</section>', '<div class="advertisement"><p>{}</p></div>']).format(_sentence(rng, 3, 45))
    if kind == "notice":
        return rng.choice(['<div class="cookie-notice">{}</div>', '<div id="consent">{}</div>', '<div class="notice">{}</div>', '<div role="dialog" class="gdpr popup">{}</div>', '<div class="alert">{}</div>']).format(p(4, 40) + rng.choice(["", "<button>OK</button>"]))
    if kind == "form":
        return rng.choice(["<form action='/s'>{}</form>", '<form class="newsletter">{}</form>', '<div class="subscribe"><form>{}</form></div>', '<form id="search">{}</form>']).format(f"<label>{_words(rng, 1, 5)}</label><input>" + rng.choice(["", p(3, 30)]) + f"<button>{_words(rng, 1, 2)}</button>")
    if kind == "share":
        return rng.choice(['<div class="share">{}</div>', '<ul class="social-links">{}</ul>', '<div class="tags">{}</div>']).format(_links(rng, rng.randint(2, 5)))
    if rng.random() < 0.4:  # readers' words by their form alone, under a name that is nothing but a name
        name = "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
        one = rng.choice(["<p>{}: {}</p>", "<li><cite>{}</cite> {}</li>", "<div><b>{}</b> {}</div>", "<div><cite>{}</cite><p>{}</p></div>", "<li><strong>{}</strong><p>{}</p></li>"])
        said = "".join(one.format(_words(rng, 1, 2).strip(".,"), _sentence(rng, 2, 25)) for _ in range(rng.randint(1, 6)))
        return rng.choice(["<div class='{}'>{}</div>", "<ul class='{}'>{}</ul>", "<section id='{}'>{}</section>", "<ol class='{}'>{}</ol>"]).format(name, rng.choice(["", f"<h3>{_words(rng, 1, 3)}</h3>"]) + said)
    inside = "".join(rng.choice(['<div class="comment"><b>{}</b>{}</div>', "<li><cite>{}</cite>{}</li>", '<article class="comment"><h4>{}</h4>{}</article>']).format(_words(rng, 1, 2), p(2, 60)) for _ in range(rng.randint(1, 6)))
    return rng.choice(['<section id="comments">{}</section>', '<div class="comments">{}</div>', '<ol class="comment-list">{}</ol>', '<div id="disqus" class="reader-comments">{}</div>', '<section class="responses discussion">{}</section>']).format(f"<h3>{_words(rng, 1, 3)}</h3>" + inside)


def _outside(rng: random.Random, kinds: tuple[str, ...], often: float, one: str = "{}") -> list[tuple[str, bool]]:
    return [(one.format(_noise(rng, kind)), False) for kind in kinds if rng.random() < (0.7 if kind == "footer" else often)]


BEFORE, AFTER = ("notice", "header", "nav", "ad", "form", "sidebar"), ("comments", "share", "sidebar", "form", "nav", "ad", "footer")
MARKED = (
    "<article>|</article>", "<main><article>|</article></main>", "<main>|</main>", '<article class="post">|</article>',
    '<div id="page"><article>|</article></div>', '<section><article itemprop="articleBody">|</article></section>',
)
PLAIN = (
    '<div class="content">|</div>', '<div id="content"><div class="post-body">|</div></div>', '<div class="entry-content">|</div>',
    '<section class="story">|</section>', "<div id='wrap'>|</div>", "<div>|</div>", "<div class='container'><div class='row'>|</div></div>",
    "<section>|</section>", '<div id="main">|</div>', '<div class="text"><div>|</div></div>', "<center>|</center>", "<body>|</body>", "|",
)


def _bare(rng: random.Random) -> str:
    """A menu, a footer or the like that only its name, or only its shape, tells apart."""
    kind = rng.random()
    name = rng.choice(["nav", "menu", "navigation", "topbar", "links"])
    if kind < 0.4:
        return rng.choice([f"<div id='{name}'>{{}}</div>", f"<div class='{name}'><ul>{{}}</ul></div>", "<ul>{}</ul>", "<div>{}</div>", "<p>{}</p>"]).format(_links(rng, rng.randint(1, 8), rng.choice(["li", "span"])))
    if kind < 0.55:
        return f"<div id='{name}'>" + " | ".join(_words(rng, 1, 2) for _ in range(rng.randint(1, 5))) + "</div>"
    if kind < 0.7:
        return rng.choice(["<div id='foot'>{}</div>", "<div class='bottom'>{}</div>", "<hr><small>{}</small>", "<p class='legal'>{}</p>"]).format(rng.choice(["&copy; ", "Copyright "]) + _words(rng, 1, 12))
    if kind < 0.85:
        return rng.choice(["<div id='top'>{}</div>", "<div class='logo'>{}</div>", "<div class='brand'><a href='/'>{}</a></div>"]).format(_words(rng, 1, 4))
    return rng.choice(["<div class='side'>{}</div>", "<div id='right-column'>{}</div>", "<div class='box widget'>{}</div>"]).format(f"<h3>{_words(rng, 1, 3)}</h3><ul>{_links(rng, rng.randint(2, 5))}</ul>")


def _table_page(rng: random.Random) -> list[tuple[str, bool]]:
    """A page laid out by table cells: a menu or a column of links beside the article."""
    side = (f"<td width=150>{rng.choice([_links(rng, rng.randint(1, 8), 'p'), _words(rng, 1, 2), _links(rng, rng.randint(2, 6), 'div'), _bare(rng)])}</td>", False)
    story = [("<td>", False), (_article(rng), True), ("</td>", False)]
    cells = [side, *story] if rng.random() < 0.7 else [*story, side]
    top = [(f"<tr><td colspan=2>{_bare(rng)}</td></tr>", False)] if rng.random() < 0.6 else []
    foot = [(f"<tr><td colspan=2>{rng.choice(['&copy; ', 'Copyright '])}{_words(rng, 1, 12)}</td></tr>", False)] if rng.random() < 0.6 else []
    return [("<table>", False), *top, ("<tr>", False), *cells, ("</tr>", False), *foot, ("</table>", False)]


def page(rng: random.Random) -> list[tuple[str, bool]]:
    """Parts of a body in order, and whether each belongs to the article."""
    parts: list[tuple[str, bool]] = [("<html><head><title>" + _words(rng, 2, 9) + "</title><style>p{}</style></head><body>", False)]
    kind = rng.random()
    if kind < 0.03:  # text without any markup of its own
        text = "\n".join(_sentence(rng, 3, 40) for _ in range(rng.randint(1, 4)))
        return rng.choice([[(text, True)], [("<html><body>", False), (text, True), ("</body></html>", False)]])
    if kind < 0.15:
        return [*parts, *_table_page(rng), ("</body></html>", False)]
    marked = kind < 0.5
    open_, close = rng.choice(MARKED if marked else PLAIN).split("|")
    if rng.random() < 0.15:  # nothing but the article
        return [*parts[: rng.randint(0, 1)], (open_, False), (_article(rng), True), (close, False)]
    parts += _outside(rng, BEFORE, 0.4)
    parts += [(_bare(rng), False) for _ in range(rng.randint(0, 2) if not marked else int(rng.random() < 0.2))]
    parts.append((open_, False))
    for k in range(rng.randint(1, 3)):
        if k:
            parts.append((_noise(rng, rng.choice(["ad", "share", "sidebar", "form", "notice"])), False))
        parts.append((_article(rng), True))
    if rng.random() < 0.4:
        parts.append((_noise(rng, rng.choice(["share", "comments", "comments", "ad"])), False))
    parts.append((close, False))
    parts += [(_bare(rng), False) for _ in range(rng.randint(0, 2) if not marked else int(rng.random() < 0.2))]
    parts += _outside(rng, AFTER, 0.35)
    parts.append(("</body></html>", False))
    return parts


def training_pages(n: int = PAGES, seed: int = 4) -> list[list[tuple[str, bool]]]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
