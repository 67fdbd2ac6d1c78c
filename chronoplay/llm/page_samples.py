"""Labelled pages for fitting the extraction model: varied layouts around an article.

Every region carries ``data-y``: 1 for the article, 0 for what surrounds or
interrupts it. The attribute is read for labels only, never as a feature.
"""

from __future__ import annotations

import random

SYLLABLES = "an ba co de en fi ga ho is jo ka le mo nu or pa qui re so ta un ve wo ya zi tion ment lich".split()


def _word(r: random.Random) -> str:
    return "".join(r.choices(SYLLABLES, k=r.randint(1, 4)))


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(low, high)))


def _sentences(r: random.Random, low: int, high: int) -> str:
    out = []
    for _ in range(r.randint(low, high)):
        s = _words(r, 1, 14).capitalize()
        if r.random() < 0.1:
            s = f'<a href="/{_word(r)}">{s}</a>'
        if r.random() < 0.1:
            s = f"<b>{s}</b>"
        out.append(s + r.choice(".....,!?"))
    return " ".join(out)


def _links(r: random.Random, low: int, high: int) -> str:
    items = [f'<a href="/{_word(r)}">{_words(r, 1, 5)}</a>' for _ in range(r.randint(low, high))]
    return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])


def _box(r: random.Random, y: int, inner: str, tags: list[str], names: list[str]) -> str:
    """``inner`` in a telling tag, in a division with a telling class or id, or, at times, in a bare one."""
    kind = r.random()
    if kind < 0.45 and tags:
        return f'<{(t := r.choice(tags))} data-y="{y}">{inner}</{t}>'
    if kind < 0.9 and names:
        name = r.choice(names)
        name = r.choice([name, f"site-{name}", f"{name}_{_word(r)}", f"{name}Box", f"{_word(r)} {name}"])
        t = r.choice(["div", "section", "div", *tags])
        return f'<{t} {r.choice(["class", "id", "class"])}="{name}" data-y="{y}">{inner}</{t}>'
    return f'<div data-y="{y}">{inner}</div>'


def _comments(r: random.Random) -> str:
    """Readers' comments: marked one by one, or plain items of a list that only its box marks."""
    name = r.choice(["comments", "comment-list", "comments-area", "user-comments", "discussion", "responses", "disqus"])
    title = f"<h{(k := r.choice('234'))}>{_words(r, 1, 5)}</h{k}>" * r.randint(0, 1)
    if r.random() < 0.5:
        each = "".join(f"<{t} class='comment'><b>{_words(r, 1, 2)}</b><p>{_sentences(r, 1, 4)}</p></{t}>" for t in r.choices(["div", "li"], k=r.randint(1, 5)))
    else:
        each = "".join(f"<li><p>{_sentences(r, 1, 4)}</p></li>" for _ in range(r.randint(1, 5)))
        each = f"<{(t := r.choice(['ol', 'ul']))}>{each}</{t}>"
    return f'<{(t := r.choice(["div", "section"]))} {r.choice(["id", "class"])}="{name}" data-y="0">{title}{each}</{t}>'


def _table_page(r: random.Random) -> str:
    """A page laid out by a table: links in its first row or column, the article in the middle, a line below."""
    links = [f'<a href="{_word(r)}">{_words(r, 1, 3)}</a>' for _ in range(r.randint(2, 7))]
    top = f'<tr><td data-y="0">{" | ".join(links[:4])}</td></tr>' * r.randint(0, 1)
    side = f'<td data-y="0">{r.choice(["<br>", "<br><br>"]).join(links)}</td>' if not top or r.random() < 0.6 else ""
    end = r.choice(["<p>", "</p><p>"]).join(_sentences(r, 1, 6) for _ in range(r.randint(1, 6)))
    body = f'<td data-y="1"><{(h := r.choice(["h1", "h2", "b"]))}>{_words(r, 2, 7)}</{h}><p>{end}</td>'
    foot = f'<tr><td data-y="0"><font size=1>{_words(r, 1, 4)}: {_words(r, 1, 6)}</font></td></tr>' * r.randint(0, 1)
    return f"<html><body><table>{top}<tr>{side}{body}</tr>{foot}</table></body></html>"


def _boilerplate(r: random.Random, kind: str) -> str:
    if kind == "nav":
        return _box(r, 0, _links(r, 3, 9), ["nav"], ["nav", "menu", "breadcrumb", "navbar", "navigation", "pagination", "toc"])
    if kind == "header":
        return _box(r, 0, f"<h1>{_words(r, 1, 4)}</h1>" * r.randint(0, 1) + f"<p>{_words(r, 1, 6)}</p>" + _links(r, 0, 3), ["header", "header"], ["header", "masthead", "banner", "logo", "topbar"])
    if kind == "footer":
        return _box(r, 0, r.choice(["&copy; ", "© 2020 ", ""]) + f"{_words(r, 1, 8)}. " + _links(r, 0, 5), ["footer"], ["footer", "copyright", "legal", "colophon"])
    if kind == "side":
        return _box(r, 0, f"<h3>{_words(r, 1, 4)}</h3>" + r.choice([_links(r, 2, 7), f"<p>{_sentences(r, 1, 3)}</p>"]), ["aside"], ["sidebar", "widget", "related", "popular", "recommended", "trending"])
    if kind == "notice":
        return _box(r, 0, f"<p>{_sentences(r, 1, 3)}</p><button>{_word(r)}</button>", ["dialog"], ["cookie", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "gdpr"])
    if kind == "ad":
        return f'<{(t := r.choice(["div", "aside", "p"]))} class="{r.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement"])}" data-y="0">{_sentences(r, 1, 3)}</{t}>'
    if kind == "form":
        return f'<form data-y="0"><label>{_words(r, 1, 4)}</label><input name="q"><p>{_sentences(r, 0, 1)}</p><button>{_word(r)}</button></form>'
    if kind == "share":
        return _box(r, 0, f"{_words(r, 1, 2)}: " * r.randint(0, 1) + _links(r, 2, 5), [], ["share", "social", "tags", "sharing"])
    if kind == "byline":
        return _box(r, 0, f'{_words(r, 1, 3)} <a href="/{_word(r)}">{_words(r, 1, 3)}</a> {_words(r, 1, 3)}' if r.random() < 0.6 else _words(r, 2, 8), [], ["byline", "meta", "entry-meta", "post-meta"])
    return _comments(r)


def _article(r: random.Random) -> str:
    parts = []
    if r.random() < 0.7:
        h = f"<h1>{_words(r, 2, 10)}</h1>"
        parts.append(r.choice([h, h, f"<header>{h}</header>"]))
    if r.random() < 0.2:
        parts.append(_boilerplate(r, "byline"))
    for _ in range(r.randint(1, 12)):
        kind = r.random()
        if kind < 0.72:
            parts.append(f"<p>{_sentences(r, 1, 8)}" + r.choice(["</p>", "</p>", "</p>", "<br>", ""]))
        elif kind < 0.8:
            parts.append(f"<h{(k := r.choice('23'))}>{_words(r, 1, 6)}</h{k}>")
        elif kind < 0.85:
            parts.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{_sentences(r, 1, 2) if r.random() < 0.6 else _words(r, 2, 9)}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>")
        elif kind < 0.9:
            parts.append(f"<blockquote><p>{_sentences(r, 1, 3)}</p></blockquote>")
        elif kind < 0.93:
            parts.append("<table>" + "".join(f"<tr><td>{_words(r, 1, 3)}</td><td>{_words(r, 1, 3)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
        elif kind < 0.96:
            parts.append(f"<figure><img src='x'><figcaption>{_sentences(r, 1, 1)}</figcaption></figure>")
        else:
            parts.append(f"<div>{_sentences(r, 1, 5)}</div>" * r.randint(1, 3))
    for kind in ("ad", "share", "form", "side", "comments"):
        if r.random() < 0.15:
            parts.insert(r.randint(1, len(parts)), _boilerplate(r, kind))
    return _box(r, 1, "".join(parts), ["article", "article", "main"], ["article", "content", "post", "entry", "story", "article-body", "post-text", "main"])


def labelled_pages(n: int, seed: int = 17) -> list[str]:
    """``n`` pages, the same ones for the same seed."""
    r, out = random.Random(seed), []
    for _ in range(n):
        if r.random() < 0.06:  # hardly any page around the text
            out.append(f'<div data-y="1">{"".join(f"<p>{_sentences(r, 1, 5)}</p>" for _ in range(r.randint(1, 4)))}</div>')
            continue
        if r.random() < 0.08:
            out.append(_table_page(r))
            continue
        before = [_boilerplate(r, k) for k in ("header", "nav", "notice", "ad", "side") if r.random() < 0.5]
        after = [_boilerplate(r, k) for k in ("comments", "side", "ad", "form", "share", "footer", "notice") if r.random() < 0.45]
        main = _article(r)
        for _ in range(r.randint(0, 2)):
            main = f"<div>{main}</div>"
        if r.random() < 0.3:
            cut = r.randint(0, len(before))
            main = _wrap(r, "".join(before[cut:]) + main + "".join(after[:2]))
            before, after = before[:cut], after[2:]
        out.append(f"<html><head><title>{_words(r, 1, 6)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>")
    return out


def _wrap(r: random.Random, inner: str) -> str:
    return f'<div class="{r.choice(["container", "wrapper", "page", "row", "site", "layout"])}">{inner}</div>'
