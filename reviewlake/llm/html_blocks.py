"""A page as its sequence of text blocks, and the same texts in other page layouts (operator 13).

``blocks`` reads any text as HTML, never fails and keeps whole texts: unclosed and stray tags, raw-text
elements, comments, character references and cut-off pages are read the way a browser would at this level.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

# Elements of HTML by what they do to text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
HIDDEN = frozenset("head template svg math select datalist object canvas audio video".split())
#: An opening tag closes open elements of these names, up to the nearest container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "body": ("head",)}
CONTAINERS = frozenset("table ul ol dl div section article main aside nav header footer form blockquote body html".split())
#: Innermost elements whose names and classes describe a block.
PATH = 16

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Block:
    text: str
    path: tuple  # (tag and its class, id and role words) of the innermost elements
    linked: int  # characters inside links
    label: str | None = None  # of the nearest element marked data-main


def _attributes(raw: str) -> tuple[tuple, str | None]:
    words, label = [], None
    if "=" in raw:
        for name, a, b, c in _ATTR.findall(raw):
            name = name.lower()
            if name in ("class", "id", "role"):
                words += ["." + w for w in _NAME.findall(_CAMEL.sub(" ", a or b or c).lower())]
            elif name == "data-main":
                label = a or b or c
    return tuple(words), label


def blocks(page: str | None) -> list[Block]:
    page, out, stack = page or "", [], []  # stack: (tag, words, label)
    parts, linked, links, hidden, pos = [], 0, 0, 0, 0

    def end_block():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = tuple((t, w) for t, w, _ in stack[-PATH:])
                out.append(Block(text, path, min(linked, len(text)), next((x for _, _, x in reversed(stack) if x), None)))
        parts, linked = [], 0

    def pop(n):
        nonlocal links, hidden
        for tag, _, _ in stack[n:]:
            links -= tag == "a"
            hidden -= tag in HIDDEN
        del stack[n:]

    def close(names, within):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if within and stack[i][0] in CONTAINERS:
                return None
        return None

    n = len(page)
    while pos < n:
        at = page.find("<", pos)
        m = _TAG.match(page, at) if at >= 0 else None
        if at < 0 or (m is None and at == n - 1):
            at = n
        if m is None and at < n:
            at += 1  # a bare "<" is text
        if at > pos and not hidden:
            parts.append(page[pos:at])
            linked += at - pos if links else 0
        pos = at
        if m is None:
            continue
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, raw = m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE:
            end_block()
        elif tag == "br":
            parts.append(" ")
        if closing:
            i = close((tag,), tag in INLINE)
            if i is not None:
                pop(i)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        if tag not in INLINE:
            i = close(("p",), True)  # a block ends an open paragraph
            if i is not None:
                pop(i)
        if tag in CLOSES:
            i = close(CLOSES[tag], tag != "body")
            if i is not None:
                pop(i)
        if tag in VOID or raw.endswith("/"):
            continue
        words, label = _attributes(raw)
        stack.append((tag, words, label))
        links += tag == "a"
        hidden += tag in HIDDEN
    end_block()
    return out


# Names by which page templates call their parts, and short texts that stand in them.
MAIN_NAMES = ("article", "article-body", "articleBody", "body-text", "content", "content-main", "entry", "entry-content", "main", "main-content",
              "mainContent", "page-content", "post", "post-body", "post-content", "story", "story-body", "text")
SIDE_NAMES = {
    "nav": ("breadcrumb", "breadcrumbs", "main-menu", "menu", "nav", "navbar", "navigation", "pagination", "site-nav", "tabs", "topnav"),
    "header": ("banner", "branding", "header", "masthead", "page-header", "site-header", "top", "topbar"),
    "footer": ("bottom", "colophon", "copyright", "footer", "legal", "page-footer", "site-footer"),
    "aside": ("aside", "recommended", "related", "related-posts", "right-column", "sidebar", "teaser", "trending", "widget"),
    "notice": ("alert", "consent", "cookie", "cookie-banner", "cookie-notice", "cookies", "gdpr", "message", "modal", "newsletter", "notice",
               "notification", "overlay", "popup", "subscribe", "warning"),
    "advert": ("ad", "ad-slot", "ads", "adsense", "advert", "advertisement", "banner-ad", "promo", "promotion", "sponsor", "sponsored"),
    "form": ("contact-form", "form", "login", "search", "search-form", "signup", "subscribe-form"),
    "comments": ("comment", "comment-list", "comments", "comments-area", "discussion", "disqus", "feedback", "replies", "responses", "reviews"),
    "share": ("share", "share-buttons", "sharing", "social", "social-links", "meta", "byline", "tags", "author-box"),
}
SIDE_TEXTS = {
    "nav": ("Home", "About", "Contact", "News", "Products", "Blog", "Next", "Previous", "Help", "Startseite", "Über uns", "Kontakt", "Accueil",
            "À propos", "Inicio", "Contacto"),
    "header": ("Welcome to our site", "The daily record", "Your source for everything", "Skip to content", "Willkommen", "Bienvenue", "Bienvenido"),
    "footer": ("© 2024 All rights reserved.", "Terms of use", "Privacy policy", "Imprint", "Impressum", "Datenschutz", "Mentions légales",
               "Aviso legal", "Powered by a small engine"),
    "aside": ("Related articles", "You may also like", "Most read", "Popular posts", "Recent posts", "Categories", "Archive"),
    "notice": ("We use cookies to improve your experience.", "Accept all", "This site uses cookies.", "Subscribe to our newsletter",
               "Wir verwenden Cookies.", "Ce site utilise des cookies.", "Este sitio utiliza cookies.", "Please enable JavaScript."),
    "advert": ("Advertisement", "Sponsored", "Buy now", "Limited offer", "Save 50% today", "Anzeige", "Publicité", "Anuncio"),
    "form": ("Search", "Name", "Email", "Your message", "Send", "Log in", "Sign up", "Password", "Suche", "Rechercher", "Buscar"),
    "comments": ("Comments", "Leave a reply", "Reply", "Great post, thanks!", "I do not agree with this.", "3 comments", "Kommentare",
                 "Commentaires", "Comentarios"),
    "share": ("Share", "Tweet", "Print", "Email this", "By the editors", "Tags", "Follow us", "Teilen", "Partager", "Compartir"),
}
TAGS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"),
        "notice": ("div", "div", "section", "aside", "p"), "advert": ("div", "div", "aside", "section"), "form": ("form", "form", "div"),
        "comments": ("section", "div", "ol", "div"), "share": ("div", "ul", "p")}
NOISE = ("box", "clearfix", "col", "col-md-8", "container", "inner", "js-block", "layout", "row", "wrapper")


def _open(rng, tag, names, named=0.9):
    name = f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}{rng.choice(("", "", " " + rng.choice(NOISE), "-" + str(rng.randint(1, 9))))}"'
    return f"<{tag}{name if rng.random() < named else ''}"


def _side(rng, kind, sentences):
    """One part of a page that is not its article."""
    tag = rng.choice(TAGS[kind])
    telling = tag in ("nav", "header", "footer", "aside", "form")
    out = [_open(rng, tag, SIDE_NAMES[kind], 0.5 if telling else 0.97), ' data-main="0">']
    say = lambda: html.escape(rng.choice(SIDE_TEXTS[kind]) if rng.random() < 0.4 else rng.choice(sentences))
    if kind in ("nav", "share") or kind in ("footer", "aside", "header") and rng.random() < 0.5:
        if kind == "aside":
            out.append(f"<h3>{say()}</h3>")
        items = [f'<li><a href="/{i}">{say() if rng.random() < 0.3 else html.escape(rng.choice(sentences).split()[0])}</a></li>'
                 for i in range(rng.randint(2, 9))]
        out.append("".join(items) if tag in ("ul", "ol", "p") else f"<ul>{''.join(items)}</ul>")
    elif kind == "form":
        out += [f'<label>{say()}</label><input name="f{i}">{rng.choice(("", "<br>", "<div>" + say() + "</div>"))}' for i in range(rng.randint(1, 4))]
        out.append(f"<button>{say()}</button>")
    elif kind == "comments":
        h = f"h{rng.randint(2, 4)}"
        out.append(f"<{h}>{say()}</{h}>" if rng.random() < 0.7 else "")
        item = "li" if tag == "ol" else "div"
        for _ in range(rng.randint(1, 6)):
            out.append(_open(rng, item, ("comment", "comment-body", "reply", "post-comment"), 0.7) + ">")
            out.append(f"<b>{html.escape(rng.choice(sentences).split()[0])}</b> wrote:" if rng.random() < 0.5 else "")
            out += [f"<p>{say()} {html.escape(rng.choice(sentences))}</p>" for _ in range(rng.randint(1, 2))]
            out.append(f"</{item}>")
    else:
        for _ in range(rng.randint(1, 3)):
            inner = rng.choice(("p", "div", "span", "", "a"))
            out.append(f"<{inner}>{say()}</{inner}>" if inner else say() + " ")
    return "".join(out) + f"</{tag}>"


def _main(rng, texts, sentences):
    """The article, with other parts inside at times."""
    tag = rng.choice(("article", "article", "main", "div", "div", "div", "section", "td"))
    out = [_open(rng, tag, MAIN_NAMES, 0.4 if tag in ("article", "main") else 0.85), ' data-main="1">']
    if rng.random() < 0.3:
        out.append(_open(rng, "div", NOISE + MAIN_NAMES) + ">")
    title = html.escape(" ".join(texts[0].split()[:12]))
    head = rng.random()
    out.append(f"<header><h1>{title}</h1></header>" if head < 0.2 else f"<h1>{title}</h1>" if head < 0.85 else "")
    for i, t in enumerate(texts):
        t, kind = html.escape(t), rng.random()
        if rng.random() < 0.06:
            out.append(f"<h2>{html.escape(' '.join(rng.choice(sentences).split()[:6]))}</h2>")
        if kind < 0.75:
            out.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<div>{}</div>", '<p class="lead">{}</p>')).format(t))
        elif kind < 0.85:
            out.append("<ul>" + "".join(f"<li>{x}</li>" for x in t.split(". ")) + "</ul>")
        else:
            out.append(rng.choice(("<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", '<p><a href="/x">{}</a></p>',
                                   "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>", "{}<br>")).format(t))
        if rng.random() < 0.05:
            out.append(_side(rng, rng.choice(("advert", "advert", "notice", "share", "aside", "form")), sentences))
    if rng.random() < 0.15:
        out.append(_side(rng, rng.choice(("share", "comments", "aside")), sentences))
    return "".join(out) + f"</{tag}>"


def dressed(texts: list[str], rng: random.Random) -> str:
    """The texts as the article of an invented page; ``data-main`` marks what is article and what is not."""
    sentences = [s for t in texts for s in re.split(r"(?<=[.!?]) ", t) if s.split()] or ["Text."]
    sentences = [" ".join(s.split()[:rng.randint(3, 25)]) for s in rng.sample(sentences, min(30, len(sentences)))]
    before = [k for k, share in (("notice", 0.35), ("header", 0.5), ("nav", 0.7), ("advert", 0.45), ("form", 0.2), ("aside", 0.25)) if rng.random() < share]
    after = [k for k, share in (("share", 0.3), ("comments", 0.5), ("aside", 0.4), ("form", 0.2), ("advert", 0.25), ("footer", 0.8), ("notice", 0.2))
             if rng.random() < share]
    if rng.random() < 0.3:
        rng.shuffle(before)
    body = [_side(rng, k, sentences) for k in before] + [_main(rng, texts, sentences)] + [_side(rng, k, sentences) for k in after]
    if rng.random() < 0.4:
        wrap = _open(rng, "div", NOISE)
        body = [wrap + ">", *body, "</div>"]
    return f"<html><head><title>{html.escape(texts[0][:60])}</title><style>p{{}}</style></head><body>{''.join(body)}</body></html>"
