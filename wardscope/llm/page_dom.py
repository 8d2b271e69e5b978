"""A page as a tree of structural elements with text blocks; a small forgiving reader of HTML."""

from __future__ import annotations

import html
import re

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
#: Elements whose content is no text of the page; dropped up to their end tag.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An opening tag ends an open sibling of these kinds, unless one of the fences is open inside.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
P_FENCES = {"table", "td", "th", "caption", "button"}
PROSE = HEADINGS | {"p", "blockquote", "pre"}
NOISE_TAGS = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar"}
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar share sharing social related recommended comment comments respond disqus login signup "
    "search skip copyright pagination pager".split()
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")
MAIN_ROLES = {"main", "article"}
#: Elements below this depth belong to their ancestor at this depth; their text stays.
DEEPEST = 32


class Page:
    """Elements in page order (0: the root) and blocks of text, each with the element that holds it.

    ``names`` are what an element presents itself as: tag, role, id without digits, classes.
    ``noise`` marks elements that their names show to be no article, ``main`` those shown to be one.
    """

    def __init__(self, source: str):
        self.tags, self.names, self.parents, self.depths = ["html"], ["html"], [-1], [0]
        self.noise, self.main = [False], [False]
        self.blocks: list[tuple[int, str]] = []
        self.links: list[tuple[int, str]] = []
        self._stack, self._open, self._text = [0], ["html"], []
        self._read(source)

    def _read(self, source: str) -> None:
        at, size, text = 0, len(source), self._text
        while at < size:
            m = TAG.search(source, at)
            if m is None:
                text.append(source[at:])
                break
            if m.start() > at:
                text.append(source[at:m.start()])
            at = m.end()
            tag = m.group(2)
            if tag is None:
                if m.group().startswith("<![CDATA["):
                    text.append(html.escape(m.group()[9:-3], quote=False))
                continue
            tag = tag.lower()
            if m.group(1):
                self._close(tag)
            elif tag in RAW:
                text.append(" ")
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.IGNORECASE).search(source, at)
                at = end.end() if end else size
            else:
                self._start(tag, m.group(3))
        self._flush()

    def _flush(self) -> None:
        if self._text:
            words = " ".join(html.unescape("".join(self._text)).split())
            if words:
                self.blocks.append((self._stack[-1], words))
            self._text.clear()

    def _pop_to(self, place: int) -> None:
        self._flush()
        del self._stack[place:], self._open[place:]

    def _start(self, tag: str, rest: str) -> None:
        given = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}
        if tag == "br" or tag == "wbr":
            self._text.append(" " if tag == "br" else "")
            return
        if tag == "img" or tag == "a":
            target = given.get("src" if tag == "img" else "href")
            if target:
                self.links.append((self._stack[-1], target))
        named = self._noise(tag, given) if given or tag in NOISE_TAGS else False
        if tag in VOID or tag in INLINE and not named:
            if tag == "hr":
                self._flush()
            return
        if tag == "html":
            return
        opened = self._open
        if tag == "body":
            self._pop_to(1)
        elif tag in CLOSES_P and "p" in opened:
            place = len(opened) - 1 - opened[::-1].index("p")
            if not P_FENCES.intersection(opened[place:]):
                self._pop_to(place)
        elif tag in SIBLINGS:
            kinds, fences = SIBLINGS[tag]
            last = None
            for place in range(len(opened) - 1, 0, -1):
                if opened[place] in kinds:
                    last = place
                if opened[place] in fences:
                    break
            if last is not None:
                self._pop_to(last)
        self._flush()
        parent = self._stack[-1]
        opened.append(tag)
        if self.depths[parent] >= DEEPEST:  # folded into its ancestor
            self._stack.append(parent)
            return
        self._stack.append(len(self.tags))
        self.tags.append(tag)
        self.names.append(self._name(tag, given) if given else tag)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.main.append(tag in ("article", "main") or given.get("role", "").lower() in MAIN_ROLES or given.get("itemprop", "").lower() == "articlebody")
        self.noise.append(named or tag == "header" and "article" not in opened and "main" not in opened)

    def _close(self, tag: str) -> None:
        opened = self._open
        if tag in INLINE and tag not in opened or tag == "html" or tag == "body":
            return
        for place in range(len(opened) - 1, 0, -1):
            if opened[place] == tag or tag in HEADINGS and opened[place] in HEADINGS:
                self._pop_to(place)
                return
        if tag not in INLINE:
            self._flush()

    @staticmethod
    def _noise(tag: str, given: dict[str, str]) -> bool:
        if tag in NOISE_TAGS or given.get("role", "").lower() in NOISE_ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true":
            return True
        if "display:none" in given.get("style", "").replace(" ", "").lower():
            return True
        return tag != "body" and any(w.lower() in NOISE_WORDS for w in WORDS.findall(given.get("class", "") + " " + given.get("id", "")))

    @staticmethod
    def _name(tag: str, given: dict[str, str]) -> str:
        return " ".join([tag, given.get("role", ""), DIGITS.sub("#", given.get("id", "")), *sorted(DIGITS.sub("#", given.get("class", "")).split())])
