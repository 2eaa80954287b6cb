"""Labelled pages from which the extraction weights are fitted.

A page is a template in which ``[[`` and ``]]`` bound the main text; ``$s`` stands
for a sentence and ``$w`` for a word of filler. They are written for this purpose
and cover the layouts that matter: semantic tags, class names only, bare tables,
tag soup with unclosed elements, and pages with little text.
"""

TEMPLATES = (
    "<html><head><title>$w $w</title></head><body><nav><ul><li><a>$w</a></li><li><a>$w</a></li><li><a>$w</a></li></ul></nav>"
    "<article>[[<h1>$w $w $w</h1><p>$s $s $s</p><p>$s <a>$w</a> $s</p><p>$s $s</p>]]</article><footer>$s <a>$w</a></footer></body></html>",
    "<body><header><a>$w</a><a>$w</a></header><main>[[<h1>$w $w</h1><p>$s<p>$s $s<p><b>$s<br><p>$s]]</main>"
    "<aside><h2>$w</h2><ul><li><a>$w $w</a></li><li><a>$w $w</a></li></ul></aside><footer>$w</footer></body>",
    "<body><div><ul><li><a>$w</a></li><li><a>$w</a></li><li><a>$w</a></li><li><a>$w</a></li></ul></div><div>$w $w</div>"
    "<div><div>[[<h2>$w $w $w</h2><p>$s $s</p><p>$s $s $s</p><ul><li>$s</li><li>$s</li></ul><p>$s</p>]]</div></div>"
    "<div><a>$w</a> <a>$w</a> <a>$w</a></div></body>",
    "<body><table><tr><td><a>$w</a><br><a>$w</a><br><a>$w</a></td><td>[[<h1>$w $w</h1><p>$s $s $s</p><p>$s</p>]]</td>"
    "<td><a>$w $w</a><br><a>$w $w</a></td></tr></table></body>",
    "<body><div><a>$w</a></div><div><a>$w</a></div><section>[[<h1>$w</h1><p>$s</p><blockquote>$s $s</blockquote><p>$s</p>]]</section>"
    "<div><div><a>$w $w $w</a></div><div><a>$w $w</a></div></div><form><input><button>$w</button></form></body>",
    "<body><nav><a>$w</a></nav><main><article>[[<header><h1>$w</h1></header><div><p>$s</p><figure><figcaption>$s</figcaption></figure><h2>$w</h2><p>$s <a>$w</a></p>"
    "<section><h3>$w</h3><ul><li><a>$w</a> $w</li><li>$w</li></ul></section><table><tr><td>$w</td><td>$w</td></tr></table></div>]]</article></main><footer>$w</footer></body>",
    "<body><nav><a>$w</a><a>$w</a></nav><article>[[<h1>$w $w $w $w</h1><p>$s</p>]]</article><footer>$w $w $w</footer></body>",
    "<body>[[<div>$w $w $w</div><p>$s</p><div>$s</div><div>$s</div><p>$w</p>]]</body>",
)
# Labelled elements: words of classes and ids by what an element with them is, whether an article is around it, and
# whether it holds running text. Which words speak for what in which place is learned from these.
NO_PART = {
    (False, False): "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner sidebar menu navbar nav navigation breadcrumb breadcrumbs footer header "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "trending widget comment comments commentlist respond replies disqus discussion pagination pager skip link legal copyright",
    (False, True): "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner sidebar footer cookie cookies consent gdpr notice notices notification popup modal "
    "overlay newsletter subscribe subscription signup login comment comments commentlist respond replies disqus discussion widget related recommended trending copyright legal",
    (True, False): "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner sidebar menu navbar nav navigation breadcrumb breadcrumbs footer toolbar cookie cookies "
    "consent popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended trending widget comment comments commentlist respond replies disqus pagination pager skip",
    (True, True): "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion cookie cookies consent popup newsletter subscribe subscription signup comment comments commentlist respond replies disqus",
}
PART = {
    (False, False): "content title headline post entry article story text body caption byline lead",
    (False, True): "content main post entry article story text body section lead intro summary chapter page column share social menu header alert navigation history link",
    (True, False): "content title headline post entry article story text body caption figure note date author byline lead header notice alert",
    (True, True): "content post entry article story text body section lead intro summary note box quote aside history share social related legal notice notices notification alert header footer menu navigation discussion "
    "sidebar widget banner copyright link overlay modal trending recommended",
}
SENTENCE = "of the and words that a writer puts in one plain sentence"
WORD = "word"


def labelled_pages() -> list[tuple[str, str, str]]:
    """(before, main, after) markup of each page."""
    out = []
    for page in TEMPLATES:
        filled = page.replace("$s", SENTENCE).replace("$w", WORD)
        before, rest = filled.split("[[")
        main, after = rest.split("]]")
        out.append((before, main, after))
    return out
