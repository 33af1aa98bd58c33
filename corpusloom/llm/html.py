"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements; each is content or not. A node's evidence (tag and words of class, id and
role of itself and the two elements above, length of its text, share of it inside links) and the potentials between parent and child are counted from labelled pages.
Sum-product messages go from the leaves up and from the root down; the marginals that they give are exact on a tree. The
text of the nodes that are likelier content than not, in page order, is the page's text.

A page is one row and is read whole in one task; pages don't depend on each other.

Nulls: a null page is empty; a page without content has the empty text. Markup may be broken: unclosed elements end with
what holds them, a head at the first thing that can't stand in one, a drawing at the first block; stray end tags are skipped,
an unclosed comment, script or style runs to the end of the page. Nesting of any depth is handled without recursion. Repeated rows are extracted once each. Empty tables give empty results. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.llm.common import map_batches, slices

#: Fixed values of the markup language: what is no block, what has no end, and whose content is no text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template iframe svg canvas audio video head".split())
RAW = frozenset("script style template iframe textarea title".split())
#: What may stand in a head (anything else ends an open one); elements of formulas, which are inline.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FORMULA = frozenset(
    "math mrow mi mo mn ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts "
    "mprescripts mtable mtr mtd maction semantics annotation annotation-xml".split()
)
#: Hidden elements that stand open as long as no end tag comes before the next of their kind; then they have no content.
ENDED = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.IGNORECASE) for name in ("canvas", "audio", "video")}
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: What can't stand in a drawing, and so ends one left open; inside the elements named second it can.
ENDS_DRAWING = PARAGRAPH_ENDS | frozenset("b body big br code dd dt em embed head i img li meta nobr ruby s small span strike strong sub sup td th tr tt u var".split())
EMBEDDING = ("foreignobject", "desc")
#: An element that ends an open one of the same group within the nearest of the elements named after it.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.DOTALL
)
ATTRIBUTE = re.compile(r"""(class|id|role|data-main|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|\Z)""", re.IGNORECASE)


class Page:
    """Block elements of a page in page order, and its runs of text with the element that holds each."""

    def __init__(self, source: str) -> None:
        self.names, self.parents, self.words, self.marked = ["#page"], [-1], [()], [False]
        self.texts: list[tuple[int, str]] = []
        self.linked: Counter[int] = Counter()
        self.size: Counter[int] = Counter()
        stack, links, at, held = [0], 0, 0, []
        hidden, opened = 0, Counter()  # opened: elements on the stack by name

        def flush() -> None:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                self.texts.append((stack[-1], text))

        def add(piece: str) -> None:
            if hidden:
                return
            held.append(piece)
            count = len(piece) - piece.count(" ")
            self.size[stack[-1]] += count
            if links:
                self.linked[stack[-1]] += count

        def close(depth: int) -> None:
            nonlocal hidden, links
            flush()
            links = 0
            for node in stack[depth:]:
                hidden -= self.names[node] in HIDDEN
                opened[self.names[node]] -= 1
            del stack[depth:]

        def close_named(name: str) -> None:
            """Closes the outermost open element of the name."""
            close(next(depth for depth, node in enumerate(stack) if self.names[node] == name))

        while match := TAG.search(source, at):
            if match.start() > at:
                if opened["head"] and self.names[stack[-1]] in ("head", "noscript") and not source[at : match.start()].isspace():
                    close_named("head")
                add(source[at : match.start()])
            at = match.end()
            if not (name := (match["name"] or "").lower()):
                continue
            if not match["end"]:
                if opened["head"] and name not in IN_HEAD:
                    close_named("head")
                if opened["svg"] and name in ENDS_DRAWING and not any(map(opened.__getitem__, EMBEDDING)):
                    close_named("svg")
            if name in FORMULA:
                if not match["end"] and name != "math":
                    add(" ")
                continue
            if name in INLINE:
                if name == "a":
                    links = max(0, links + (-1 if match["end"] else 1))
                continue
            if name == "br":
                add(" ")
                continue
            if match["end"]:
                for depth in range(len(stack) - 1, 0, -1) if opened[name] else ():
                    if self.names[stack[depth]] == name:
                        close(depth)
                        break
                continue
            group, fence = SIBLINGS.get(name, ({"p"}, {"td", "th", "li", "dd"}) if name in PARAGRAPH_ENDS else ((), ()))
            for depth in range(len(stack) - 1, 0, -1) if any(map(opened.__getitem__, group)) else ():
                if self.names[stack[depth]] in group:
                    close(depth)
                    break
                if self.names[stack[depth]] in fence:
                    break
            flush()
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(match["rest"])} if match["rest"] else {}
            self.names.append(name)
            self.parents.append(stack[-1])
            self.words.append(tuple(re.findall(r"[a-z]+", " ".join(found.get(k, "") for k in ("class", "id", "role")).lower())))
            self.marked.append("data-main" in found)
            if name in VOID or match["rest"].endswith("/") and (name in HIDDEN or name in ("object", "noscript")):
                continue
            if name in ENDED and not ((ending := ENDED[name].search(source, at)) and ending[1]):
                continue
            if name in RAW:
                ending = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(source, at)
                stop, after = (ending.start(), ending.end()) if ending else (len(source), len(source))
                if name not in HIDDEN and name != "title":
                    stack.append(len(self.names) - 1)
                    add(source[at:stop])
                    flush()
                    stack.pop()
                at = after
                continue
            stack.append(len(self.names) - 1)
            opened[name] += 1
            hidden += name in HIDDEN
        if opened["head"] and self.names[stack[-1]] in ("head", "noscript") and source[at:].strip():
            close_named("head")
        add(source[at:])
        flush()

    def features(self, node: int) -> list[str]:
        """Evidence of a node: its own, and the tags and words of the two elements above it."""
        size, linked = self.size[node], self.linked[node]
        out = [f"tag {self.names[node]}", f"size {min(6, size.bit_length() // 2) if size else 'none'}"]
        if size:
            out.append(f"links {4 * linked // size}")
        out += [f"word {w}" for w in self.words[node]]
        above = self.parents[node]
        for _ in range(2):
            if above > 0:
                out += [f"under {self.names[above]}", *(f"under word {w}" for w in self.words[above])]
                above = self.parents[above]
        return out


#: Labelled pages of other layouts, authored: content is marked by data-main.
LABELLED = [
    # an article between navigation, notice, advert and footer
    '<html><head><title>t</title><script>x</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>'
    '<div class="ad">Buy two of these and get the third one for nothing today.</div><article data-main><h1 data-main>How the harbour was rebuilt</h1>'
    '<p data-main>The old harbour wall had stood for ninety years when the storm of that winter took forty metres of it away.</p>'
    '<p data-main>Short one.</p><p data-main>Work on the new wall began two years later, and by then the fishing boats had long moved to the next town along the coast.</p>'
    '</article><footer>Copyright of the harbour news, all rights kept.</footer></body></html>',
    # main with a header inside the page, a sidebar and comments
    '<body><header><div class="logo">The Daily</div><nav class="menu"><ul><li><a>World</a></li><li><a>Sport</a></li></ul></nav></header>'
    '<div class="cookie-notice" role="dialog"><p>We use cookies to make this page better for you and our partners. <a>Accept</a></p></div>'
    '<main data-main id="content"><section data-main><h1 data-main>Bread without kneading</h1><h2 data-main>What you need</h2><ul data-main><li data-main>Flour, water and salt</li><li data-main>A warm place</li></ul>'
    '<p data-main>Mix everything in a bowl the evening before and leave it under a cloth until the morning comes.</p><blockquote data-main><p data-main>Patience is the only kneading this dough needs.</p></blockquote></section></main>'
    '<aside class="sidebar"><h3>Related</h3><ul><li><a>Rolls in an hour</a></li></ul><p>Sign up for our letter and never miss a recipe again.</p></aside>'
    '<section class="comments" id="comments"><h2>Comments</h2><div class="comment"><p>I tried this on Sunday and it worked out very well for all of us, thank you!</p></div>'
    '<form class="comment-form"><label>Your name</label><textarea>Write here</textarea><button>Send</button></form></section>'
    '<footer class="footer"><div><p>Contact us by letter or by phone during the usual hours.</p></div></footer></body>',
    # no semantic elements, only classes
    '<div id="page" data-main><div id="header" class="header"><h1>My Weblog</h1><p>Notes on almost everything</p></div><div class="nav"><a>Home</a> <a>About</a></div>'
    '<div id="main" data-main><div class="post entry" data-main><h2 data-main>On walking</h2><div class="post-content body text" data-main><p data-main>Walking is the slowest way to think and for that reason it may well be the best one that we have.</p>'
    '<p data-main>I walk every morning.</p><pre data-main>left right left</pre><table data-main><tr data-main><td data-main>Day</td><td data-main>Steps</td></tr></table></div></div></div>'
    '<div class="share social"><a>Share this</a></div><div id="sidebar" class="widget"><p>Older posts of this weblog can be found in the archive by month.</p></div>'
    '<div class="banner advert sponsored promo"><p>Shoes for walking at half the price, only for a few days, in every shop of ours.</p></div>'
    '<div id="footer" class="footer copyright"><p>Written and kept by one person since long ago.</p></div></div>',
    # plain body
    '<body><h1 data-main>Minutes of the meeting</h1><p data-main>Present were all members of the board but two, who had sent their excuses the day before.</p><dl data-main><dt data-main>Item one</dt>'
    '<dd data-main>The budget was approved as it had been proposed by the treasurer.</dd></dl><hr><p class="footer">Printed by the office.</p></body>',
    '<body><p data-main>Only one paragraph stands on this page, and all that the page has to say is said by it.</p></body>',
    # article with parts that are not content inside it
    '<body><div class="topbar notice alert"><p>Our shop will be closed on Monday because of the holiday, please order in good time.</p></div><div class="breadcrumb"><a>Home</a> <a>Science</a></div>'
    '<article class="article story" data-main><header data-main><h1 data-main>Light from far away</h1></header><p data-main>The light that reached the mirror that night had been on its way for nine billion years.</p>'
    '<aside class="related"><p>More on this: what mirrors are made of and how they are cleaned every spring.</p></aside><figure data-main><img><figcaption data-main>The mirror at dusk</figcaption></figure>'
    '<p data-main>It was seen for eleven minutes only, and then the clouds came and stayed for a week.</p><div class="ad-slot ads advertisement"><p>Telescopes for everyone, now with free delivery to your door.</p></div>'
    '<footer class="tags meta"><a>Stars</a> <a>Light</a></footer></article><div class="newsletter subscribe signup"><form><p>Get the best stories of the week by mail every Friday.</p><input><button>Go</button></form></div>'
    '<div id="disqus_thread" class="responses replies discussion"><p>Readers wrote: what a lovely story this was, I have read it to my children twice.</p></div></body>',
    '<body><main data-main><h1 data-main>A short note</h1><p data-main>One line of it.</p><aside><p>More notes like this one are kept in the archive</p></aside><nav><ul><li><a>Next</a></li></ul></nav>'
    '<section class="comments"><p>A reader wrote that the note was too short</p></section></main><aside><p>From the same hand</p></aside><footer><p>Written at home.</p></footer></body>',
    '<body><article data-main><p data-main>Two trains leave the station at the same time and neither of them is late.</p><aside class="notice"><p>This story is for members, please sign in to read on</p></aside>'
    '<footer><p>Filed under trains and stations</p></footer></article><form><p>Write to us</p></form></body>',
    # comments in other dress, and headers with title and motto
    '<body><header><h1>The Weekly Letter</h1><p>Everything about the town and the land around it</p></header><div id="header"><h1>Town and Country</h1></div><div class="post" data-main><h1 data-main>A new bridge</h1>'
    '<p data-main>The bridge over the river will be open in spring, two years after the old one was closed.</p><table data-main><tr data-main><td data-main>Length</td></tr></table><ul data-main><li data-main>Two lanes</li></ul></div>'
    '<section class="comments"><h2>Comments</h2><article class="comment"><p>At last, I have waited for that bridge longer than for anything else in my life!</p></article><ol class="comment-list"><li class="comment"><p>Me too.</p></li></ol></section>'
    '<div id="cookies">This page stores small files on your device.</div><section class="sponsored"><p>Paint for every bridge, now in all colours you can think of.</p></section></body>',
    '<body><header><p>Welcome to our site</p><h1>Our Site</h1></header><article data-main><h1 data-main>Rain</h1><pre data-main>drop drop</pre><blockquote data-main>It rained for a week.</blockquote><p data-main>Then it stopped.</p></article>'
    '<div id="comments"><h3>Replies</h3><article class="comment"><p>Here it still rains and it does not look as if it would stop.</p></article><article class="comment"><p>Same.</p></article></div></body>',
    '<body><header><h1>Garden Notes</h1></header><div class="header"><h1>Garden</h1><p>Notes</p></div><article data-main><h2 data-main>Beans</h2><ul data-main><li data-main>Beans want warm soil and a pole that is taller than you think they will ever need.</li>'
    '<li data-main>Water them at the root and never on the leaves, and in the evening rather than at noon.</li></ul><p data-main>That is all there is to it.</p></article><header><h1>Garden Notes</h1></header></body>',
    '<body><div id="header"><h1>Sea Watch</h1></div><header><h1>Sea Watch</h1></header><main data-main><article data-main><p data-main>The sea was calm.</p><p data-main>Nothing was seen from the tower on that day but a few gulls and one grey boat.</p></article></main></body>',
    '<body><article data-main><p data-main>A page of one article with one paragraph of middling length.</p></article></body>',
    '<body><article data-main><p data-main>What there was to say is said in one sentence.</p><section class="comments"><div class="comment"><p>Well said, and short, which I like best of all.</p></div></section></article></body>',
    '<body><article data-main><h1 data-main>Keys</h1><p data-main>Lost and found.</p><form><label>Mail</label><textarea>text</textarea></form></article><footer>The end</footer></body>',
    '<article data-main><h1 data-main>Hats</h1><p data-main>A hat keeps the sun off and the rain too.</p><p data-main>It does nothing against wind.</p></article>',
    '<body><article data-main><ol data-main><li data-main>Close the door behind you when you leave the house in the morning, and leave the key with the neighbour.</li><li data-main>Do not forget it.</li></ol></article></body>',
    '<body><div class="article" data-main><h1 data-main>Snow</h1><p data-main>It snowed all night and in the morning the road was gone.</p></div></body>',
    # boilerplate inside the main part
    '<body><div class="post" data-main><h1 data-main>Tea</h1><p data-main>A few words about it that fill about a line of text.</p>'
    '<ul data-main><li data-main>Some of it</li></ul><div class="menu"><a>One</a></div><aside><p>More of this</p></aside><aside>More</aside><footer>End of it</footer><form><label>Mail</label><button>Send</button></form><div class="notice">Members only, please.</div><div class="ad">Buy now.</div><div class="advert">Buy this.</div><div class="share"><a>Share</a></div><div id="cookies">We store cookies.</div><nav><a>Up</a></nav><p data-main>Short.</p></div></body>',
    '<body><div id="content" data-main><h1 data-main>Salt</h1><p data-main>A few words about it that fill about a line of text.</p>'
    '<ul data-main><li data-main>Some of it</li></ul><div class="menu"><a>One</a></div><aside><p>More of this</p></aside><aside>More</aside><footer>End of it</footer><form><label>Mail</label><button>Send</button></form><div class="notice">Members only, please.</div><div class="ad">Buy now.</div><div class="advert">Buy this.</div><div class="share"><a>Share</a></div><div id="cookies">We store cookies.</div><nav><a>Up</a></nav><p data-main>Short.</p></div></body>',
    '<body><div class="article body" data-main><h1 data-main>Soap</h1><p data-main>A few words about it that fill about a line of text.</p>'
    '<ul data-main><li data-main>Some of it</li></ul><div class="menu"><a>One</a></div><aside><p>More of this</p></aside><aside>More</aside><footer>End of it</footer><form><label>Mail</label><button>Send</button></form><div class="notice">Members only, please.</div><div class="ad">Buy now.</div><div class="advert">Buy this.</div><div class="share"><a>Share</a></div><div id="cookies">We store cookies.</div><nav><a>Up</a></nav><p data-main>Short.</p></div></body>',
    '<body><div role="main" data-main><h1 data-main>Wool</h1><p data-main>A few words about it that fill about a line of text.</p>'
    '<ul data-main><li data-main>Some of it</li></ul><div class="menu"><a>One</a></div><aside><p>More of this</p></aside><aside>More</aside><footer>End of it</footer><form><label>Mail</label><button>Send</button></form><div class="notice">Members only, please.</div><div class="ad">Buy now.</div><div class="advert">Buy this.</div><div class="share"><a>Share</a></div><div id="cookies">We store cookies.</div><nav><a>Up</a></nav><p data-main>Short.</p></div></body>',
    '<body><nav><p>Skip to content</p></nav><main data-main><p data-main>Text in the main part.</p><form class="search"><p>Search this site for words</p></form><div class="popup modal overlay"><p>Do not leave yet, there is so much more to see here for you.</p></div>'
    '<div class="content" data-main>Bare words stand in a division of the main part without any paragraph around them at all.</div></main><footer><ul><li>Imprint</li><li>Privacy</li></ul><p>All prices include the tax where it applies.</p></footer></body>',
]


#: Labelled pages of ordinary layouts: every chain of elements around the text, between every pair of surroundings.
CHAINS = (
    (), ("div",), ("div", "div"), ("div", "div", "div"), ("section",), ("div", "section"), ('div class="wrapper"',), ('div class="page"',), ("center",),
    ('div id="container"', 'div class="row"', 'div class="col"'), ("table", "tr", "td"), ('div class="outer"', 'div class="inner"'),
    ("article", 'div class="row"', 'div class="col"', "div"), ("main", "div"),
)
SURROUNDINGS = (
    ("", ""),
    ("<ul><li><a>Home</a></li><li><a>News</a></li></ul>", '<div class="footer"><p>All rights kept by the owners of this page.</p></div>'),
    ('<div class="menu"><a>One</a> <a>Two</a></div>', "<footer><p>Printed by the office of the town.</p></footer>"),
    ('<nav><ul><li><a>Up</a></li></ul></nav><div class="banner ad"><p>Shoes at half the price, only today.</p></div>',
     '<div class="sidebar"><p>More stories are found in the archive.</p></div>'),
    ('<div class="sponsor-box"><p>This page is brought to you by the makers of fine boots and hats.</p></div>',
     '<div class="comments"><p>What a fine page this is, I have read it twice already!</p></div>'),
)
OPENINGS = ("<body>", "<html><head><title>t</title></head><body>", "<html><body>")
SENTENCES = (
    "The ferry left the island at noon and came back with the mail an hour before dark.", "Nobody had expected the roof to hold for another winter, but it did.", "It rained.",
    "She wrote down what the old men said about the river, the mill and the two bridges that had stood there before the war.",
    "There were eleven of them, and each had brought something to eat.", "Why this was so is hard to say.",
    "Most of the letters were lost, although a few turned up years later in a drawer of the town hall.",
)


def bodies() -> list[str]:
    """Labelled texts: paragraphs in different numbers with and without a title, bare words, lists, divisions."""
    out = []
    for k in (1, 2, 3, 6, 14):
        paragraphs = "".join(f"<p data-main>{SENTENCES[(k + i) % len(SENTENCES)]}</p>" for i in range(k))
        out += [paragraphs, f"<h1 data-main>About the ferry</h1>{paragraphs}"]
    items = "".join(f"<li data-main>{x}</li>" for x in (SENTENCES[1], f"<a>{SENTENCES[4]}</a>", "<a>Mail</a>"))
    return [
        f"{SENTENCES[0]} {SENTENCES[3]}", f"<h2 data-main>Notes</h2><ul data-main>{items}</ul><p data-main>{SENTENCES[6]}</p>", *out,
        "".join(f"<div data-main>{SENTENCES[i]}</div>" for i in (0, 3, 6)),
    ]


def laid_out(chain: tuple[str, ...], opening: str, around: tuple[str, str], body: str) -> str:
    """A labelled page; a body that holds the text itself is content like any other element around it."""
    begin = "".join(f"<{name} data-main>" for name in chain)
    end = "".join(f"</{name.split()[0]}>" for name in reversed(chain))
    return (opening if chain else opening.replace("<body>", "<body data-main>")) + around[0] + begin + body + end + around[1]


def ordinary(chains: tuple[tuple[str, ...], ...] = CHAINS) -> list[str]:
    """Two pages for each chain, opening and surroundings: of the bodies the first two in turn, and another."""
    texts, out = bodies(), []
    for i, chain in enumerate(chains):
        for j, around in enumerate(SURROUNDINGS):
            for k, opening in enumerate(OPENINGS):
                out += [laid_out(chain, opening, around, texts[(i + j + k) % 2]), laid_out(chain, opening, around, texts[(i * 7 + j * 3 + k * 5) % len(texts)])]
    return out


class Model:
    """Log potentials counted from labelled pages."""

    def __init__(self, pages: Iterable[Page], weight: float = 0.2) -> None:
        seen, pairs, total = (Counter(), Counter()), Counter(), Counter()
        for page in pages:
            for node in range(1, len(page.names)):
                y = page.marked[node]
                total[y] += 1
                pairs[page.marked[page.parents[node]], y] += 1
                seen[y].update(page.features(node))
        self.prior = math.log((total[True] + 1) / (total[False] + 1))
        self.evidence = {
            f: math.log((seen[1][f] + weight) / (total[True] + 1)) - math.log((seen[0][f] + weight) / (total[False] + 1)) for f in {*seen[0], *seen[1]}
        }
        # between parent and child, over what the child's own share explains
        share = {y: (total[y] + 1) / (total[True] + total[False] + 2) for y in (False, True)}
        of = {x: pairs[x, False] + pairs[x, True] + 2 for x in (False, True)}
        self.pair = [[(pairs[x, y] + 1) / of[x] / share[y] for y in (False, True)] for x in (False, True)]

    def marginals(self, page: Page) -> list[float]:
        """Probability of content for every node, by messages up and down the tree; the root of a page is not content."""
        size, pair = len(page.names), self.pair
        get = self.evidence.get
        own = [(1.0, 0.0)]
        for node in range(1, size):
            score = max(-30.0, min(30.0, self.prior + sum(get(f, 0.0) for f in page.features(node))))
            own.append((1.0, math.exp(score)))
        below, up = [list(o) for o in own], [(1.0, 1.0)] * size
        for node in range(size - 1, 0, -1):  # children come after their parents
            no, yes = below[node]
            norm = no + yes
            no, yes = no / norm, yes / norm
            up[node] = message = (pair[0][0] * no + pair[0][1] * yes, pair[1][0] * no + pair[1][1] * yes)
            parent = below[page.parents[node]]
            parent[0] *= message[0]
            parent[1] *= message[1]
            if (norm := parent[0] + parent[1]) < 1e-100 or norm > 1e100:
                parent[0], parent[1] = parent[0] / norm, parent[1] / norm
        out, belief = [0.0] * size, [(1.0, 0.0)] * size
        for node in range(1, size):
            no, yes = belief[page.parents[node]]
            rest = (no / max(up[node][0], 1e-300), yes / max(up[node][1], 1e-300))  # the parent without this child
            norm = rest[0] + rest[1]
            rest = (rest[0] / norm, rest[1] / norm)
            no = below[node][0] * (rest[0] * pair[0][0] + rest[1] * pair[1][0])
            yes = below[node][1] * (rest[0] * pair[0][1] + rest[1] * pair[1][1])
            belief[node] = (no / (no + yes), yes / (no + yes))
            out[node] = belief[node][1]
        return out


def training_pages(chains: tuple[tuple[str, ...], ...] = CHAINS) -> list[str]:
    """The authored pages count three times. Every chain but the empty one has an element around the text besides the body, so the
    empty one counts ten times."""
    return LABELLED * 3 + ordinary(((),) * 9 * (() in chains) + chains)


@functools.lru_cache(maxsize=1)
def trained() -> Model:
    return Model([Page(p) for p in training_pages()])


def main_text(source: str | None, model: Model | None = None) -> str:
    page = Page(source or "")
    likely = (model or trained()).marginals(page)
    return "\n\n".join(text for node, text in page.texts if likely[node] > 0.5)


def extract(pages: DataFrame, model: Model | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """Key and ``text`` of every row. ``model``: potentials from other labelled pages than the built-in ones."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "html"):
            yield {c: part.column(c) for c in others} | {"text": [main_text(h, model) for h in part.column("html").to_pylist()]}

    others = [c for c in pages.columns if c not in (html, "text")]
    narrow = pages.select(*[F.col(f"`{c}`") for c in others], F.col(html).alias("html"))
    kinds = StructType([*(narrow.schema[c] for c in others), StructField("text", StringType())])
    return map_batches(narrow, run, kinds)
