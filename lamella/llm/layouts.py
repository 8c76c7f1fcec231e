"""Labelled pages: whole page layouts in which every text says whether it is content.

``{+12}`` stands for twelve words of content, ``{-3}`` for three words of boilerplate. The pages are written as sites write
them: names that one site gives to its sidebar another gives to a chapter, so that no name decides by itself where
sites disagree.
"""

from __future__ import annotations

import re
from functools import lru_cache

MARK = "zq"

#: Bodies of articles, as sites mark them up.
CONTENT = (
    "<h1>{+6}</h1><p>{+30}</p><p>{+25}</p><h2>{+3}</h2><p>{+40}</p>",
    "<h1><a href='/a'>{+5}</a></h1><p>{+20}<br>{+9}</p><ul><li>{+4}</li><li>{+2}</li></ul><p>{+12}</p>",
    "<header><h1>{+7}</h1></header><p>{+3}</p><blockquote><p>{+14}</p></blockquote><pre>{+9}</pre><p>{+1}</p>",
    "<div class='entry-header'><h1>{+5}</h1></div><div class='entry-content'><p>{+22}</p><p>{+18}</p></div>",
    "<h1>{+4}</h1><figure><img src='x.png'><figcaption>{+8}</figcaption></figure><p>{+26}</p><table><tr><th>{+1}</th><th>{+1}</th></tr><tr><td>{+2}</td><td>{+3}</td></tr></table>",
    "<h2>{+6}</h2><p>{+16}</p><h3>{+2}</h3><ol><li>{+10}</li><li>{+11}</li></ol><p><a href='/s'>{+4}</a></p><ul><li><a href='/r'>{+3}</a></li><li><a href='/t'>{+2}</a></li></ul>",
    "<h1>{+3}</h1><div class='abstract'><p>{+30}</p></div><section class='related-work'><h2>{+2}</h2><p>{+35}</p></section><section class='conclusion'><p>{+20}</p></section>",
    "<h1>{+5}</h1><p class='lead'>{+15}</p><p class='social-history'>{+24}</p><div class='legal'><p>{+28}</p></div><p>{+19}</p>",
    "<div class='intro'>{+18}</div><div class='text'><p>{+21}</p><div class='note'>{+13}</div></div><dl><dt>{+2}</dt><dd>{+9}</dd></dl>",
    "<h1>{+4}</h1><div class='meta-analysis'><p>{+17}</p></div><section id='shared-memory'><h2>{+2}</h2><p>{+22}</p></section><section id='user-comments-study'><p>{+16}</p></section>",
    "<h1>{+3}</h1><div class='recipe-ingredients'><ul><li>{+2}</li><li>{+3}</li><li>{+2}</li></ul></div><div class='recipe-steps'><ol><li>{+12}</li><li>{+14}</li></ol></div>",
    "<h1>{+4}</h1><p>{+2}</p><p>{+1}</p><p>{+6}</p><h4>{+1}</h4><p>{+3}</p>",
    "<h1>{+6}</h1><section class='notice-of-meeting'><p>{+20}</p></section><section class='tag-theory'><p>{+14}</p></section><div class='promotion-law'><p>{+15}</p></div>",
    "<h1>{+2}</h1><div class='search-algorithms'><p>{+19}</p></div><div class='login-protocol'><p>{+12}</p></div><div class='subscription-economy'>{+16}</div><p id='footer-design'>{+11}</p>",
    "<h1>{+3}</h1><section class='legal-framework'><p>{+14}</p></section><section class='social-policy'><p>{+12}</p></section><section class='related-theory'><p>{+4}</p></section><div class='shared-values'><p>{+12}</p></div>",
    "<h1>{+4}</h1><section class='popular-music'><p>{+11}</p></section><section id='banner-history'><p>{+13}</p></section><section id='menu-planning'><p>{+10}</p></section><div class='notice-period'><p>{+3}</p></div>",
    "<h1>{+4}</h1><section class='alert-system'><p>{+11}</p></section><section id='feedback-loops'><p>{+13}</p></section><section id='navigation-at-sea'><p>{+10}</p></section><div class='recommended-dose'><p>{+3}</p></div>",
    "<h1>{+5}</h1><section class='methods'><p>{+18}</p></section><section class='discussion'><h2>{+1}</h2><p>{+27}</p></section><section class='references'><ul><li><a href='/r'>{+9}</a></li><li><a href='/q'>{+7}</a></li></ul></section>",
    "<h1>{+2}</h1><p class='comment-on-law'>{+13}</p><div class='column'><p>{+23}</p></div><div class='column'><p>{+20}</p></div><h3>{+2}</h3><p>{+5}</p>",
    "<h2>{+2}</h2><p>{+4}</p><h3>{+3}</h3><p>{+7}</p><ul><li>{+1}</li><li>{+1}</li></ul>",
    "<p>{+24}</p><p>{+31}</p>",
    "<p>{+1}</p>",
    "<p>{+3}</p><p>{+2}</p><p>{+5}</p>",
    "{+2}",
    "{+4}<p>{+6}</p>{+1}",
    "{+22}<br>{+12}<p>{+9}</p>",
)

#: What stands around a body.
FRAMES = (
    "<article>{}</article>",
    "<main>{}</main>",
    "<main><article>{}</article></main>",
    "<article class='post'>{}</article>",
    "<div role='main'>{}</div>",
    "<div class='wrap'><article itemprop='articleBody'>{}</article></div>",
    "<div class='legal'><article>{}</article></div>",
    "<div class='post meta'><article>{}</article></div>",
    "<div class='content'>{}</div>",
    "<div id='content'><div class='inner'>{}</div></div>",
    "<div id='article-body'>{}</div>",
    "<section class='post entry'>{}</section>",
    "<div class='post-content'>{}</div>",
    "<div class='story'><div class='body'>{}</div></div>",
    "<div class='page'><div class='text'>{}</div></div>",
    "<div class='main-column'>{}</div>",
    "<div id='primary'><div class='single'>{}</div></div>",
    "<div id='main'>{}</div>",
    "<section>{}</section>",
    "<div>{}</div>",
    "{}",
)

#: What sites put before, beside and after it.
FURNITURE = (
    "<nav><ul><li><a href='/'>{-1}</a></li><li><a href='/b'>{-1}</a></li><li><a href='/c'>{-2}</a></li></ul></nav>",
    "<nav class='navbar'><a href='/'>{-1}</a> <a href='/b'>{-1}</a></nav>",
    "<header><div class='logo'>{-2}</div><p>{-5}</p></header>",
    "<header class='site-header'><h1>{-2}</h1><nav><a href='/'>{-1}</a></nav></header>",
    "<header><h1>{-2}</h1></header>",
    "<header><h1>{-1}</h1><p>{-6}</p></header>",
    "<header><a href='/'><h1>{-2}</h1></a></header>",
    "<header id='top'><h1>{-3}</h1><p>{-9}</p></header>",
    "<header class='page-header'><h1>{-2}</h1><p>{-4}</p></header>",
    "<div class='header'><h1>{-2}</h1></div>",
    "<div id='header'><h2>{-3}</h2><p>{-6}</p></div>",
    "<div class='header'>{-4}</div>",
    "<div class='masthead'><p>{-4}</p></div>",
    "<footer><p>{-9}</p><a href='/i'>{-1}</a></footer>",
    "<footer class='site-footer'>{-12}</footer>",
    "<div id='footer'><p>{-10}</p><p>{-4}</p></div>",
    "<div class='footer'>{-8}</div>",
    "<div class='copyright'>{-6}</div>",
    "<aside><h3>{-2}</h3><p>{-12}</p></aside>",
    "<aside class='pull'>{-9}</aside>",
    "<div class='sidebar'><h3>{-2}</h3><p>{-16}</p><ul><li><a href='/x'>{-3}</a></li></ul></div>",
    "<div class='left sidebar'><p>{-10}</p></div>",
    "<div id='side'><p>{-9}</p></div>",
    "<div class='side-bar'><p>{-9}</p></div>",
    "<div class='rail'><p>{-7}</p></div>",
    "<div class='ad'>{-8}</div>",
    "<div class='ads'><p>{-7}</p></div>",
    "<div class='ad-slot'>{-4}</div>",
    "<div class='ad-banner'><p>{-5}</p></div>",
    "<div class='advert'>{-11}</div>",
    "<div class='advertisement'><p>{-10}</p></div>",
    "<div class='sponsored'>{-9}</div>",
    "<div class='sponsor'>{-5}</div>",
    "<div class='promo'><p>{-8}</p></div>",
    "<div class='promo-box'>{-8}</div>",
    "<div class='banner'>{-7}</div>",
    "<div role='banner'>{-3}</div>",
    "<div role='navigation'><a href='/q'>{-2}</a></div>",
    "<div role='complementary'><p>{-9}</p></div>",
    "<div role='contentinfo'>{-6}</div>",
    "<div role='search'>{-2}</div>",
    "<div id='cookie-notice'>{-12}</div>",
    "<div class='cookie-banner'><p>{-14}</p><button>{-1}</button></div>",
    "<div class='cookies'>{-13}</div>",
    "<div id='cookie-consent'><p>{-11}</p></div>",
    "<div class='cookie-law-popup'>{-12}</div>",
    "<div class='footer-links'><a href='/z'>{-2}</a></div>",
    "<div class='comments-area'><p>{-12}</p></div>",
    "<div class='comment-thread'><p>{-13}</p></div>",
    "<div class='sidebar-right'><p>{-12}</p></div>",
    "<div class='nav-links'>{-3}</div>",
    "<div class='related-links'><p>{-9}</p></div>",
    "<div class='newsletter-form'><p>{-10}</p></div>",
    "<div class='ad-container'><p>{-11}</p></div>",
    "<div class='consent'><p>{-15}</p></div>",
    "<div class='gdpr'>{-14}</div>",
    "<div class='notice'>{-9}</div>",
    "<div class='site-notice'><p>{-9}</p></div>",
    "<div class='alert'>{-6}</div>",
    "<div class='popup'><p>{-9}</p></div>",
    "<div class='modal'><p>{-10}</p></div>",
    "<div class='overlay'>{-8}</div>",
    "<div class='newsletter'><p>{-11}</p></div>",
    "<div class='newsletter-signup'>{-9}</div>",
    "<div class='subscribe'><p>{-7}</p></div>",
    "<div class='subscribe-box'><p>{-8}</p></div>",
    "<div class='signup'>{-6}</div>",
    "<div class='paywall'><p>{-12}</p></div>",
    "<form action='/s'><p>{-6}</p><label>{-1}</label><button>{-1}</button></form>",
    "<form class='search'><input><button>{-1}</button></form>",
    "<div class='login'><p>{-4}</p></div>",
    "<div class='search-box'>{-3}</div>",
    "<fieldset><label>{-2}</label></fieldset>",
    "<button>{-2}</button>",
    "<label>{-3}</label>",
    "<menu><li>{-1}</li><li>{-1}</li></menu>",
    "<dialog><p>{-8}</p></dialog>",
    "<search><p>{-4}</p></search>",
    "<ul class='menu'><li><a href='/m'>{-1}</a></li><li><a href='/n'>{-1}</a></li></ul>",
    "<div class='main-menu'><a href='/m'>{-1}</a></div>",
    "<div id='nav'><a href='/m'>{-2}</a></div>",
    "<ul class='nav'><li>{-1}</li><li>{-1}</li></ul>",
    "<div class='navigation'><p>{-3}</p></div>",
    "<div class='top-bar'><p>{-4}</p></div>",
    "<div class='topbar'>{-4}</div>",
    "<div class='toolbar'>{-3}</div>",
    "<div class='breadcrumb'><a href='/'>{-1}</a> <a href='/k'>{-1}</a></div>",
    "<ol class='breadcrumbs'><li><a href='/'>{-1}</a></li><li>{-2}</li></ol>",
    "<div class='pagination'><a href='/2'>{-1}</a></div>",
    "<div class='pager'>{-2}</div>",
    "<div class='share'><a href='/f'>{-1}</a><a href='/t'>{-1}</a></div>",
    "<div class='share-buttons'>{-4}</div>",
    "<div class='sharing'><p>{-3}</p></div>",
    "<ul class='social'><li><a href='/f'>{-1}</a></li></ul>",
    "<div class='social-links'>{-3}</div>",
    "<div class='social-media'><p>{-4}</p></div>",
    "<div class='related'><h3>{-2}</h3><ul><li><a href='/o'>{-5}</a></li></ul></div>",
    "<section class='related-posts'><h3>{-2}</h3><a href='/o'>{-6}</a></section>",
    "<div class='related-articles'><p>{-7}</p></div>",
    "<div class='recommended'><a href='/o'>{-5}</a></div>",
    "<div class='recommendations'><p>{-6}</p></div>",
    "<div class='trending'><p>{-6}</p></div>",
    "<div class='popular-posts'><p>{-8}</p></div>",
    "<div class='popular'>{-6}</div>",
    "<div class='widget'><p>{-8}</p></div>",
    "<div class='widget-area'><p>{-8}</p></div>",
    "<div class='comments'><h3>{-2}</h3><div class='comment'><p>{-16}</p></div><article><p>{-12}</p></article></div>",
    "<section id='comments'><p>{-14}</p><p>{-9}</p></section>",
    "<section class='comments'><article><p>{-13}</p></article></section>",
    "<ol class='comment-list'><li><p>{-11}</p></li></ol>",
    "<ul class='commentlist'><li>{-10}</li></ul>",
    "<div class='comment-body'><p>{-15}</p></div>",
    "<div class='user-comment'>{-12}</div>",
    "<div id='respond'><p>{-6}</p></div>",
    "<div class='replies'><p>{-12}</p></div>",
    "<div class='reply'><p>{-9}</p></div>",
    "<div id='disqus'><p>{-10}</p></div>",
    "<div class='discussion-thread'><p>{-15}</p></div>",
    "<div class='reader-feedback'><p>{-14}</p></div>",
    "<div class='feedback'><p>{-10}</p></div>",
    "<div class='byline'>{-4}</div>",
    "<div class='tags'><a href='/t'>{-1}</a></div>",
    "<div class='tag-list'>{-3}</div>",
    "<div class='meta'><span>{-4}</span></div>",
    "<div class='post-meta'>{-4}</div>",
    "<div class='legal-notice'>{-12}</div>",
    "<p class='legal'><a href='/l'>{-2}</a></p>",
    "<div class='skip-link'><a href='#c'>{-3}</a></div>",
    "<a class='skip' href='#c'>{-3}</a>",
    "<div hidden>{-9}</div>",
    "<p style='display:none'>{-9}</p>",
    "<div aria-hidden='true'>{-5}</div>",
    "<div class='hidden'>{-7}</div>",
    "<p><a href='/a'>{-2}</a> <a href='/b'>{-2}</a> <a href='/c'>{-1}</a></p>",
    "<ul><li><a href='/a'>{-2}</a></li><li><a href='/b'>{-3}</a></li></ul>",
    "<div><a href='/a'>{-1}</a> <a href='/b'>{-1}</a></div>",
)

#: Loose text that only an article beside it shows to be none of it.
LOOSE = ("<div><p>{-7}</p></div>", "<p>{-4}</p>", "<div class='column'><p>{-11}</p></div>", "<h2>{-2}</h2>", "<section><h2>{-2}</h2><p>{-6}</p></section>")
#: Furniture of an article's own.
INNER = ("<footer><p>{-8}</p></footer>", "<header><p>{-4}</p></header>", "<aside><p>{-10}</p></aside>", "<nav><a href='/p'>{-1}</a></nav>")

_HOLE = re.compile(r"\{([+-])(\d+)\}")


def filled(layout: str) -> str:
    """The layout with words in its holes; those of content begin with the mark."""
    return _HOLE.sub(lambda m: " ".join([MARK if m[1] == "+" else "word"] * int(m[2])), layout)


@lru_cache(maxsize=1)
def pages() -> tuple[tuple[str, str], ...]:
    """(page, mark) of all labelled pages: every body in every frame, with furniture dealt out in turn before, inside and
    after it, twice over. Frames that mark an article also have loose text beside them."""
    out, turn = [], 0

    def deal(n: int) -> str:
        nonlocal turn
        turn += n
        return "".join(FURNITURE[i % len(FURNITURE)] for i in range(turn - n, turn))

    for frame in (*FRAMES, *FRAMES):
        marked = "<article" in frame or "<main" in frame or "'main'" in frame
        for i, body in enumerate(CONTENT):
            first, end, last = body.partition("</p>")
            inner = INNER[i % len(INNER)] if marked else deal(1)
            body = first + end + deal(1) + last + inner if i % 2 else body
            before, after = deal(2), deal(2)
            if marked and i % 3 == 0:
                before, after = before + LOOSE[i % len(LOOSE)], LOOSE[(i + 1) % len(LOOSE)] + after
            out.append((filled(f"<body>{before}{frame.replace('{}', body)}{after}</body>"), MARK))
    return tuple(out)
