"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship

FEATURES = 1 << 14
TRAIN_PAGES, TRAIN_CHARS, COMPOSED = 200, 100_000, 900  # documented bounds: pages of the sample, the longest page learned from, composed pages

# Elements that end a block, elements without content, and elements whose content is never text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot "
    "th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template".split())
TO_THE_END = frozenset("script style".split())  # where one of these is not closed, the rest of the page is its content
SHUTS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
HOLDS = frozenset("ul ol dl table select body div article section main".split())  # an implied end does not reach past these

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
TOKEN = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Leaf:
    text: str
    context: frozenset  # features of the ancestors
    parent: str
    linked: int  # characters inside links


def _marks(tag: str, rest: str) -> list[str]:
    found = [f"<{tag}"]
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            found.append(".hidden")
        elif name != "style":
            for token in TOKEN.findall(CAMEL.sub("-", value).lower()):
                if token.isalpha():
                    found += [f".{token}"] + ([f"^{token[:5]}"] if len(token) > 5 else [])
    return found


def leaves(page: str | None) -> list[Leaf]:
    """The text blocks of a page in order, with what stands above each; markup that is broken ends at the page's end.

    Character references are decoded and white space inside a block becomes one space. Comments, scripts, styles and
    templates hold no text; formulas, drawings and fallback text are text like any other. A block ends at every start or end of a block element; unclosed paragraphs, items and cells end where HTML ends them.
    """
    out: list[Leaf] = []
    stack: list[tuple[str, frozenset]] = []
    parts: list[str] = []
    state = {"linked": 0, "in_link": False, "in_drawing": False}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(Leaf(text, stack[-1][1] if stack else frozenset(), stack[-1][0] if stack else "", state["linked"]))
        parts.clear()
        state["linked"] = 0

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if state["in_link"]:
                state["linked"] += len(text.strip())

    at, page = 0, page or ""
    while True:
        m = MARKUP.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if not m:
            flush()
            return out
        at = m.end()
        if m.group(0).startswith("<![CDATA["):
            parts.append(m.group(0)[9:].removesuffix("]]>"))
            continue
        tag = (m.group("tag") or "").lower()
        if not tag:
            continue
        if m.group("end"):
            if tag == "a":
                state["in_link"] = False
            if tag == "svg":
                state["in_drawing"] = False
            if tag in BLOCK and not (tag == "title" and state["in_drawing"]):
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            continue
        if tag in RAW:
            if not m.group("rest").endswith("/>"):
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page) if tag in TO_THE_END else at
        elif tag == "a":
            state["in_link"] = True
        elif tag == "svg":
            state["in_drawing"] = not m.group("rest").endswith("/>")
        elif tag == "br" or (tag in ("title", "text", "tspan", "desc") and state["in_drawing"]):  # a drawing's title ends no block
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            state["in_link"] = False
            shut = SHUTS.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    del stack[k:]
                    break
                if stack[k][0] in HOLDS:
                    break
            if tag not in VOID:
                above = stack[-1][1] if stack else frozenset()
                stack.append((tag, above.union(_marks(tag, m.group("rest")))))


# What is written around articles, by kind, in the languages of the pages. A short block is judged by these words
# too, so that a container without a telling name, or without a name, is known by what it says.
PHRASES = {
    "menu": "Home|About us|News|Contact|Categories|Archive|Skip to content|Menu|Startseite|Über uns|Kontakt|Accueil|À propos|Inicio|Quiénes somos|Sitemap",
    "foot": "Copyright 2024|All rights reserved|Privacy policy|Terms of use|Imprint|Impressum|Datenschutz|Alle Rechte vorbehalten|Mentions légales|Tous droits réservés|Aviso legal|Todos los derechos reservados|Powered by WordPress|Legal notice|AGB",
    "side": "Related articles|Read more|Most read|You may also like|Recommended for you|Popular posts|Weiterlesen|Mehr zum Thema|Lire la suite|À lire aussi|Leer más|Más leídas|Recent posts|Trending now|Previous article|Next article",
    "notice": "This site uses cookies|We use cookies to improve your experience|Accept all cookies|Cookie settings|Subscribe to our newsletter|Sign up for updates|Wir verwenden Cookies|Akzeptieren|Newsletter abonnieren|Nous utilisons des cookies|Accepter|Utilizamos cookies|Aceptar|Enter your email",
    "advert": "Advertisement|Sponsored|Promoted content|Anzeige|Werbung|Publicité|Sponsorisé|Publicidad|Patrocinado|Buy now|Special offer|Ad",
    "share": "Share|Tweet|Share on Facebook|Teilen|Partager|Compartir|Print|Drucken|Email this|Follow us|Tags",
    "form": "Search|Log in|Sign in|Register|Username|Password|Suche|Anmelden|Rechercher|Connexion|Buscar|Iniciar sesión|Submit|Send",
    "comment": "Comments|3 comments|Leave a reply|Leave a comment|Reply|Log in to comment|Post a comment|Kommentare|Kommentar schreiben|Antworten|Commentaires|Laisser un commentaire|Répondre|Comentarios|Deja un comentario|Responder|Join the discussion|Show more comments",
}
SAYING = re.compile(r"[^\W\d_]+")
PLAIN_WORDS = frozenset("a all by for in may next now of on our the this to up we you your us more de la le les des los no todos nous uses use über uns wir zum mehr quiénes somos à".split())
CUES = frozenset(w for text in PHRASES.values() for w in SAYING.findall(text.lower())) - PLAIN_WORDS
SHORT = 12  # words of a block that is judged by what it says


def _slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode()) % FEATURES


def features(blocks: list[Leaf]) -> list[np.ndarray]:
    """Hashed features of every block: its ancestors' tags and attribute words, its parent, and its text."""
    contexts: dict[frozenset, list[int]] = {}
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        if b.context not in contexts:
            contexts[b.context] = [_slot(c) for c in b.context]
        words = b.text.count(" ") + 1
        own = [
            "bias", f"parent {b.parent}", f"words {min(6, words.bit_length())}", f"links {round(4 * min(1.0, b.linked / len(b.text)))}",
            f"stop {b.text[-1] in '.!?…。»”'}", f"mark {any(c in b.text for c in '©®|»›·')}", f"place {3 if n == 1 else 0 if i == 0 else 2 if i == n - 1 else 1}",
        ]
        if words <= SHORT:
            said = CUES.intersection(SAYING.findall(b.text.lower()))
            own += [f"says {w}" for w in said] + [f"telling {words <= 3} {bool(said)}"]
        out.append(np.unique(np.array(contexts[b.context] + [_slot(f) for f in own], dtype=np.int64)))
    return out


@dataclass
class Chain:
    """Weights of a two-label chain (0 outside, 1 main text): per feature and label, and per pair of neighbours."""

    emit: np.ndarray  # [FEATURES, 2]
    step: np.ndarray  # [2, 2]

    def scores(self, blocks: list[np.ndarray]) -> np.ndarray:
        return np.array([self.emit[f].sum(axis=0) for f in blocks]).reshape(-1, 2)

    def viterbi(self, blocks: list[np.ndarray]) -> list[int]:
        """The labels of highest total score."""
        scores, step = self.scores(blocks).tolist(), self.step.tolist()
        if not scores:
            return []
        best, back = scores[0], []
        for s in scores[1:]:
            came = [0 if best[0] + step[0][y] >= best[1] + step[1][y] else 1 for y in (0, 1)]
            back.append(came)
            best = [best[came[y]] + step[came[y]][y] + s[y] for y in (0, 1)]
        labels = [0 if best[0] >= best[1] else 1]
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return labels[::-1]

    def expected(self, blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels and of neighbouring pairs by the forward-backward recursion."""
        s = self.scores(blocks)
        n = len(s)
        ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
        ahead[0] = s[0]
        for i in range(1, n):
            ahead[i] = s[i] + np.logaddexp(ahead[i - 1, 0] + self.step[0], ahead[i - 1, 1] + self.step[1])
        for i in range(n - 2, -1, -1):
            after = s[i + 1] + behind[i + 1]
            behind[i] = np.logaddexp(self.step[:, 0] + after[0], self.step[:, 1] + after[1])
        total = np.logaddexp(ahead[-1, 0], ahead[-1, 1])
        single = np.exp(ahead + behind - total)
        pairs = np.zeros((2, 2))
        if n > 1:
            joint = ahead[:-1, :, None] + self.step[None] + (s[1:] + behind[1:])[:, None, :] - total
            pairs = np.exp(joint).sum(axis=0)
        return single, pairs


def train(pages: list[tuple[list[np.ndarray], list[int]]], epochs: int = 12, ridge: float = 1e-4) -> Chain:
    """Maximum conditional likelihood by stochastic gradient with per-weight rates, pages in a fixed random order."""
    chain = Chain(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    grown, grown_step = np.full((FEATURES, 2), 1e-3), np.full((2, 2), 1e-3)
    pages = [p for p in pages if p[0]]
    draw = Random(11)
    for _ in range(epochs):
        for k in draw.sample(range(len(pages)), len(pages)):
            blocks, labels = pages[k]
            single, pairs = chain.expected(blocks)
            truth = np.eye(2)[labels]
            gap = truth - single
            gradient = np.zeros((FEATURES, 2))
            index = np.concatenate(blocks)
            np.add.at(gradient, index, np.repeat(gap, [len(f) for f in blocks], axis=0))
            touched = np.unique(index)
            g = gradient[touched] - ridge * chain.emit[touched]
            grown[touched] += g * g
            chain.emit[touched] += 0.3 * g / np.sqrt(grown[touched])
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            g = seen - pairs - ridge * chain.step
            grown_step += g * g
            chain.step += 0.3 * g / np.sqrt(grown_step)
    return chain


# Containers of labelled pages. A page of the training set is composed of them and of the text of sample pages.
MAIN = [
    "<article>", "<main>", '<div class="content">', '<div class="post-body">', '<div class="entry-content">', '<div id="main-text">', '<div class="story">',
    '<section class="article-text">', '<div itemprop="articleBody">', '<div class="article">', '<main role="main">', '<div id="content">', '<div class="text">',
    '<div class="post">', '<section>', "<div>", '<div class="page">', '<div class="body">', "",
]
WRAPPERS = ['<div class="container">', '<div class="row">', '<div class="wrapper">', '<div id="page">', '<div class="col-md-8">', '<div class="inner">', "<div>", '<div class="grid">', "<section>"]
OUTSIDE = {
    "menu": ["<nav>", '<ul class="menu">', '<div id="navigation">', '<div class="breadcrumbs">', '<div class="nav">', '<div role="navigation">', '<div class="toc">', "<menu>"],
    "head": ["<header>", '<div class="site-header">', '<div id="header">', '<div class="masthead">', '<div role="banner">', '<div class="topbar">', '<div class="logo">'],
    "foot": ["<footer>", '<div class="footer">', '<div id="footer">', '<div id="copyright">', '<div role="contentinfo">', '<div class="legal">', '<div class="imprint">'],
    "side": ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<div class="related">', '<div class="recommended">', '<div role="complementary">', '<div class="teaser">'],
    "notice": ['<div class="cookie-notice">', '<div class="notice">', '<div id="cookies">', '<div class="consent">', '<div class="alert">', '<div class="newsletter">', '<div class="subscribe">', '<div class="popup">', "<dialog>", '<div class="gdpr">', '<div class="paywall">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<div class="ad-banner">', '<aside class="ad">', '<div class="sponsor">'],
    "form": ["<form>", '<form class="search">', '<div class="login">', '<fieldset>', '<div class="signup">', '<form id="contact">'],
    "comment": ['<div class="comments">', '<section id="comments">', '<div class="comment">', '<div class="comment-list">', '<ol class="commentlist">', '<div class="replies">', '<div id="respond">', '<div class="discussion">', '<section class="reader-comments">', '<div class="reviews">', '<article class="comment">'],
    "share": ['<div class="share">', '<div class="social">', '<div class="tags">', '<div class="pagination">', '<div class="hidden">', "<div hidden>"],
}
# what tells such a container: its element or the words of its attributes, without those that an article may have too
COMMON = frozenset("<div <section <ul <ol <article <header .header .site .list .reader".split())
TELLS = frozenset(m for openings in OUTSIDE.values() for x in openings for m in _marks(*re.match(r"<(\w+)([^>]*)", x).groups()) if m[0] != "^") - COMMON
SPARE_TEXT = ["A short line of text that stands for a paragraph of an article.", "Another one, somewhat longer, with two parts. It ends here.", "Read on"]


def compose(draw: Random, texts: list[str]) -> tuple[str, list[int]]:
    """A labelled page: main text with noise around and between, in random containers; the label of each block."""
    labels: list[int] = []

    def close(opening: str) -> str:
        return f"</{re.match(r'<(\w+)', opening).group(1)}>" if opening else ""

    def wrapped(inner: str) -> str:
        """The same in containers that say nothing, some with a name that occurs once."""
        for _ in range(draw.choice([0, 0, 1, 1, 2])):
            opening = draw.choice([*WRAPPERS, f'<div class="x{draw.randint(0, 10**6)} {draw.choice("abcdefgh")}{draw.choice("klmnop")}{draw.choice("aeiou")}">'])
            inner = opening + inner + close(opening)
        return inner

    def paragraph(label: int) -> str:
        labels.append(label)
        text = html.escape(draw.choice(texts))
        return f"<p>{text}</p>" if draw.random() < 0.8 else f"<p>{text}<br>" if draw.random() < 0.5 else f"<div>{text}</div>"

    def unnamed(opening: str) -> str:
        """Often without the words that would tell: what stands inside has to."""
        return draw.choice([opening, "<div>", f'<div class="y{draw.randint(0, 10**6)}">', f'<section id="z{draw.randint(0, 10**6)}">'])

    def saying(kind: str) -> str:
        labels.append(0)
        text = html.escape(draw.choice(PHRASES[kind].split("|")))
        if kind == "foot" and draw.random() < 0.6:
            text = draw.choice(["&copy; ", "© ", "Copyright "]) + f"{draw.randint(1998, 2026)} " + html.escape(" ".join(draw.choice(texts).split()[:2]))
        tag = draw.choice(["p", "div", "li", "h3", "h4"])
        return f"<{tag}>{text}</{tag}>" if draw.random() < 0.6 else f'<{tag}><a href="/x">{text}</a></{tag}>'

    def noise(kinds: list[str]) -> str:
        kind = draw.choice(kinds)
        opening = draw.choice(OUTSIDE[kind])
        if kind in PHRASES and draw.random() < 0.4:
            opening = unnamed(opening)
            inner = "".join(saying(kind) for _ in range(draw.randint(1, 4)))
            if kind == "comment":
                inner += "".join(paragraph(0) for _ in range(draw.randint(1, 3))) + (saying(kind) if draw.random() < 0.5 else "")
        elif kind in ("menu", "share") and draw.random() < 0.8:
            opening = unnamed(opening) if draw.random() < 0.3 else opening
            n = draw.randint(2, 7)
            labels.extend([0] * n)
            words = [html.escape(draw.choice(texts).split()[0]) for _ in range(n)]
            inner = "<ul>" + "".join(f'<li><a href="/x">{w}</a></li>' for w in words) + "</ul>"
        elif kind in ("foot", "notice", "advert", "head") and draw.random() < 0.6:
            labels.append(0)
            inner = ("&copy; " if kind == "foot" else "") + html.escape(draw.choice(texts))
        else:
            inner = "".join(paragraph(0) for _ in range(draw.randint(1, 4)))
        return opening + inner + close(opening)

    def several(kinds: list[str], most: int) -> str:
        return "".join(noise(kinds) for _ in range(draw.randint(0, most)))

    if draw.random() < 0.08:  # text without any markup, or without a container
        n = draw.randint(1, 6)
        if draw.random() < 0.4:
            labels.append(1)
            return "\n".join(html.escape(draw.choice(texts)) for _ in range(n)), labels
        return "".join(paragraph(1) for _ in range(n)), labels
    page = "<html><head><title>" + html.escape(draw.choice(texts)[:40]) + "</title></head><body>"
    labels.append(0)
    page += "".join(wrapped(noise(["menu", "head", "notice", "advert", "form", "side"])) for _ in range(draw.randint(0, 4)))
    opening, before = draw.choice(MAIN), page
    page = opening
    if draw.random() < 0.6:
        labels.append(1)
        title = f"<h1>{html.escape(draw.choice(texts)[:60])}</h1>"
        page += f"<header>{title}</header>" if draw.random() < 0.15 else title
    for _ in range(draw.randint(1, 7)):
        kind = draw.random()
        if kind < 0.1:
            n = draw.randint(2, 4)
            labels.extend([1] * n)
            items = [html.escape(draw.choice(texts)[: draw.choice([20, 80, 400])]) for _ in range(n)]
            page += "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if draw.random() < 0.7 else "<table><tr>" + "".join(f"<td>{x}</td>" for x in items) + "</tr></table>"
        elif kind < 0.2:
            labels.append(1)
            page += f"<{draw.choice(['h2', 'blockquote', 'pre', 'figcaption', 'li', 'td'])}>" + html.escape(draw.choice(texts))
            page += "</h2></blockquote></pre></figcaption></li></td>"
        else:
            page += paragraph(1)
        if draw.random() < 0.12:
            page += noise(["advert", "side", "share", "notice", "form"])
    inside = several(["comment", "share", "advert", "form"], 1) if draw.random() < 0.4 else ""
    page = before + wrapped(page + inside + close(opening))
    page += several(["comment", "side", "form", "notice", "foot", "share", "advert", "menu"], 4)
    return page + several(["foot"], 1) + "</body></html>", labels


def marked(blocks: list[Leaf]) -> list[int]:
    """The labels that a page gives itself: main text is inside an article and in none of the containers outside of the text."""
    return [int("<article" in b.context and not TELLS & b.context) for b in blocks]


def labelled(pages: list[str]) -> list[tuple[list[np.ndarray], list[int]]]:
    """Training pages: sample pages that mark their article themselves, and composed ones with the sample's text.

    A third of the sample pages are learned a second time without the words of their attributes: text and structure decide.
    """
    out, texts = [], []
    for page in pages:
        blocks = leaves(page)
        truth = marked(blocks)
        if any(truth):
            out.append((features(blocks), truth))
            if len(out) % 3 == 0:
                bare = [Leaf(b.text, frozenset(m for m in b.context if m[0] == "<"), b.parent, b.linked) for b in blocks]
                out.append((features(bare), truth))
        texts += [b.text[:400] for b in blocks[:40]]  # of the training text only
    draw = Random(5)
    texts = texts or SPARE_TEXT
    for _ in range(COMPOSED):
        page, truth = compose(draw, texts)
        blocks = leaves(page)
        if len(blocks) == len(truth):
            out.append((features(blocks), truth))
    return out


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Chain:
    """The chain, learned from a sample of about ``train_pages`` pages drawn by a hash of id and page."""
    total = pages.count()
    share = int(min(1.0, train_pages / max(total, 1)) * (1 << 30))
    drawn = F.pmod(F.xxhash64(F.col("page_id").cast("bigint"), F.col("html").cast("string")), F.lit(1 << 30)) < share  # by the page too: ids may be missing
    sample = pages.filter(drawn & (F.length("html") <= TRAIN_CHARS)).select(F.col("html").cast("string").alias("html")).limit(2 * train_pages)
    return train(labelled(sorted(r.html for r in sample.collect())))


def extracted(pages: DataFrame, chain: Chain) -> DataFrame:
    """Per row: ``page_id``, ``url``, ``text`` (blocks labelled main text, joined by newlines), ``n_chars``, ``n_blocks``, ``n_kept``.

    Whole pages are read, one batch at a time, without a shuffle. Null and empty pages have an empty text; rows that repeat
    get the same result; null ids and urls pass through; extra columns are ignored; an empty table gives no rows.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, all_blocks, kept = [], [], []
            for page in batch.column(2).to_pylist():
                blocks = leaves(page)
                main = [b.text for b, y in zip(blocks, chain.viterbi(features(blocks))) if y]
                texts.append("\n".join(main))
                all_blocks.append(len(blocks))
                kept.append(len(main))
            arrays = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(all_blocks, pa.int32()), pa.array(kept, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks int, n_kept int")
