"""Pages written by hand in the manner of kinds of public sites, with their main text.

Between ``[[`` and ``]]`` stands main text; ``marked`` takes the marks out and gives
the page and the words between them.
"""

import html
import re

PAGES = [
    # a blog of a common kind
    """<!DOCTYPE html><html><head><title>On bread - A kitchen</title><link rel=stylesheet href=s.css></head><body class="post-template-default single">
<div id="masthead" class="site-header"><div class="site-branding"><a href="/" rel="home">A kitchen</a><p class="site-description">Notes from a small stove</p></div>
<ul id="primary-menu" class="menu"><li class="menu-item"><a href="/about">About</a></li><li class="menu-item"><a href="/recipes">Recipes</a></li></ul></div>
<div id="content" class="site-content"><article id="post-71" class="post-71 post type-post"><header class="entry-header"><h1 class="entry-title">[[On bread]]</h1></header>
<div class="entry-content">[[<p>I started baking when the shop on our street closed. It was winter, and nobody wanted to walk to the next one.</p><p>Flour, water, salt and time are all you need. The last of these is the hardest to find.</p>
<h2>The starter</h2><p>Mix equal parts of rye flour and water. Leave the jar where it is warm, and feed it each morning for a week.</p><ul><li>Use a clean jar.</li><li>Throw away half before feeding.</li></ul><p>When it doubles in four hours it is ready.</p>]]</div>
<div class="sharedaddy sd-sharing"><h3>Share this:</h3><ul><li><a href="#">Twitter</a></li><li><a href="#">Facebook</a></li></ul></div></article>
<div id="comments" class="comments-area"><h2>2 thoughts on On bread</h2><ol class="comment-list"><li class="comment"><b>Ana</b><p>Mine never doubled, even after two weeks. What did I do wrong?</p></li><li class="comment"><b>Tom</b><p>Lovely post, thank you so much for sharing it with us.</p></li></ol><form class="comment-form"><p>Leave a reply. Your address will not be published.</p><label>Name</label><input><button>Post Comment</button></form></div></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent Posts</h2><ul><li><a href="#">Soup again</a></li><li><a href="#">What to do with leeks</a></li></ul></section></aside>
<footer class="site-footer"><div class="site-info"><a href="#">Proudly powered by a blog engine</a></div></footer></body></html>""",
    # an encyclopaedia
    """<html><body class="skin-vector"><div id="mw-page-base"></div><div id="content" class="mw-body"><h1 id="firstHeading">[[River terrace]]</h1><div id="bodyContent"><div id="siteSub">From an encyclopaedia</div>
<div id="mw-content-text" class="mw-parser-output">[[<p>A <b>river terrace</b> is a step-like landform that flanks the side of a <a href="/floodplain">floodplain</a>. It consists of a fairly level strip of land, called a tread, parted from other strips by distinct slopes called risers.</p><p>Terraces are the remnants of an earlier floodplain. They form when the river cuts down more quickly than it widens its valley.</p>
<h2>Kinds</h2><p>Paired terraces stand at the same height on both sides. Unpaired ones do not, and tell of a river that wandered while it cut.</p><table class="wikitable"><tr><th>Kind</th><th>Cause</th></tr><tr><td>Fill</td><td>The valley is filled and cut again</td></tr><tr><td>Strath</td><td>Bedrock is cut</td></tr></table>]]</div></div></div>
<div id="mw-navigation"><h2>Navigation menu</h2><div id="p-personal"><ul><li><a href=#>Talk</a></li><li><a href=#>Contributions</a></li><li><a href=#>Log in</a></li></ul></div><div id="p-search"><form><input type=search><input type=submit value=Go></form></div><div class="portal" id="p-tb"><h3>Tools</h3><ul><li><a href=#>What links here</a></li><li><a href=#>Cite this page</a></li></ul></div></div>
<div id="footer"><ul><li>This page was last edited on 4 May 2019, at 11:02.</li><li>Text is available under a licence; additional terms may apply.</li></ul></div></body></html>""",
    # old, tables for layout, no names at all
    """<HTML><HEAD><TITLE>Lighthouse keepers</TITLE></HEAD><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2><FONT SIZE=5>The Coast Pages</FONT></TD></TR>
<TR><TD WIDTH=120 VALIGN=top><A HREF=a.htm>Home</A><BR><A HREF=b.htm>Towers</A><BR><A HREF=c.htm>Keepers</A><BR><A HREF=d.htm>Guest book</A></TD>
<TD VALIGN=top>[[<H2>Lighthouse keepers</H2><P>The first keeper at the point was a widow from the north. She tended the light for thirty-one years and never missed a night.<P>Oil had to be carried up one hundred and twelve steps. In winter the stairs froze, and the cans were pulled up on a rope.<P>When the light was made electric in 1934 the house was let to summer guests. It burned down two years later.]]</TD></TR>
<TR><TD COLSPAN=2><HR><FONT SIZE=1>Page made by the Coast Society. Best seen at 800 by 600. Mail the webmaster.</FONT></TD></TR></TABLE></BODY></HTML>""",
    # a newspaper with much around the text
    """<html><body><div class="cmp-layer"><p>Wir und unsere Partner verwenden Cookies, um Inhalte zu personalisieren. Sie koennen jederzeit widersprechen.</p><button>Alle akzeptieren</button></div>
<header class="c-header"><a class="c-logo" href=/>Der Morgen</a><nav class="c-nav"><a href=#>Politik</a><a href=#>Sport</a><a href=#>Kultur</a><a href=#>Wetter</a></nav></header>
<main><div class="o-grid"><div class="o-col"><h1 class="c-headline">[[Bahn baut die alte Bruecke neu]]</h1><div class="c-meta"><a href=#>Von K. Blum</a></div>
<div class="c-copy">[[<p>Die Bruecke ueber den Fluss wird im kommenden Jahr gesperrt. Das teilte die Bahn am Montag mit.</p><p>Seit 1911 traegt sie zwei Gleise. Die Pfeiler sind aus Sandstein und haben schon zwei Hochwasser ueberstanden.</p>]]<div class="c-ad"><p>Anzeige. Jetzt guenstig Strom wechseln und sparen!</p></div>[[<p>Der Neubau soll achtzehn Monate dauern. In dieser Zeit fahren Busse, die etwa zwanzig Minuten laenger brauchen.</p><blockquote>Wir wissen, was das fuer die Pendler heisst, sagte der Leiter des Baus.</blockquote><p>Der Stadtrat will im Herbst noch einmal beraten.</p>]]</div></div>
<div class="o-rail"><div class="c-teaser"><a href=#>Streit um den Marktplatz</a><p>Die Haendler wollen mehr Platz.</p></div><div class="c-teaser"><a href=#>Regen bis Freitag</a><p>Erst am Wochenende wird es besser.</p></div></div></div></main>
<div class="c-newsletter"><p>Der Tag am Abend: Melden Sie sich fuer unseren Brief an.</p><form><input><button>Anmelden</button></form></div><footer class="c-footer"><a href=#>Impressum</a> <a href=#>Datenschutz</a> <a href=#>Kontakt</a></footer></body></html>""",
    # a manual
    """<html><body><div class="md-container"><div class="md-sidebar md-sidebar--primary"><ul class="md-nav__list"><li><a href=#>Getting started</a></li><li><a href=#>Install</a></li><li><a href=#>Configuration</a></li><li><a href=#>Reference</a></li></ul></div>
<div class="md-content"><article class="md-content__inner md-typeset">[[<h1>Configuration</h1><p>The server reads one file at start. Set its place with the <code>--config</code> flag.</p><pre><code>listen = 8080
workers = 4</code></pre><h2>Workers</h2><p>Each worker handles requests on its own. Use as many as there are cores, and one more if the disk is slow.</p><dl><dt>listen</dt><dd>The port to listen on.</dd><dt>workers</dt><dd>How many workers to start.</dd></dl><p>Changes take effect after a restart.</p>]]</article></div>
<div class="md-sidebar md-sidebar--secondary"><ul><li><a href=#>Workers</a></li></ul></div></div><footer class="md-footer"><nav><a href=#>Previous Install</a><a href=#>Next Reference</a></nav><div class="md-footer-meta">Made with a generator</div></footer></body></html>""",
    # a recipe
    """<html><body><div class="top"><a href=/>spoonful</a> <a href=#>Dinners</a> <a href=#>Cakes</a></div><div class="hrecipe">[[<h1>Lentil soup</h1><p>A soup for the first cold week. It keeps for three days and is better on the second.</p><h3>You need</h3><ul class="ingredients"><li>200 g brown lentils</li><li>1 onion, chopped</li><li>2 carrots</li><li>1 litre of stock</li></ul><h3>How to</h3><ol><li>Fry the onion until soft. Add the carrots.</li><li>Add lentils and stock, and cook for forty minutes.</li><li>Season with vinegar, and serve.</li></ol>]]</div>
<div class="rate"><p>Rate this recipe!</p><form><select><option>1<option>2<option>3</select><button>Send</button></form></div><div class="cards"><h3>You may also like</h3><div><a href=#>Pea soup</a></div><div><a href=#>Onion tart</a></div></div><div class="reviews"><div class="review"><b>mira88</b><p>Too much vinegar for me, but the kids ate it all.</p></div><div class="review"><b>oldcook</b><p>I used red lentils. Worked fine.</p></div></div><div class="bot">Copyright spoonful 2017. All rights reserved. <a href=#>Privacy</a></div></body></html>""",
    # a notice of an authority
    """<html lang=en><body><a class="skiplink" href="#main">Skip to main content</a><div id="global-cookie-message" role="region"><p>This site uses cookies to make it simpler. Find out more about cookies.</p></div><header role="banner"><a href=/>Services</a></header><div class="breadcrumbs"><ol><li><a href=#>Home</a></li><li><a href=#>Driving</a></li></ol></div>
<main id="main" role="main"><h1>[[Renew a licence]]</h1><div class="govspeak">[[<p>You must renew your licence every ten years. You will need a new photograph.</p><p>It costs 14 by post and 12 online. You can keep driving while your application is handled if your doctor has not told you to stop.</p><h2>Renew by post</h2><p>Fill in the form and send it with your old licence. It takes about three weeks.</p>]]</div><div class="report-a-problem"><p>Is there anything wrong with this page?</p><form><label>What went wrong?</label><input><button>Send</button></form></div></main>
<div class="related-items"><h2>Related content</h2><ul><li><a href=#>Change your address</a></li><li><a href=#>Penalty points</a></li></ul></div><footer role="contentinfo"><ul><li><a href=#>Help</a></li><li><a href=#>Terms</a></li></ul><p>All content is available under an open licence, except where otherwise stated.</p></footer></body></html>""",
    # divs without names, paragraphs by breaks
    """<html><body><div><div><a href=/>index</a> - <a href=/p>poems</a> - <a href=/m>mail</a></div><div>[[<h3>The well</h3>My grandfather dug the well by himself. He was nineteen, and had never dug anything before.<br><br>At twelve feet he struck a rock the size of a cow. He went around it, which is why the shaft leans to the east.<br><br>The water is still good. We draw it in August, when the pipes run brown.]]</div><div>&copy; 2004 by the author. Nothing here may be copied.</div></div></body></html>""",
    # a single page application, rendered
    """<html><body><div id="root"><div class="sc-a1"><div class="sc-nav"><button>Menu</button><a href=#>For you</a><a href=#>Following</a></div><div class="sc-b2"><h1 class="sc-title">[[Why our tests were slow]]</h1><div class="sc-c3"><section>[[<p class="sc-p">Last month a run of our tests took forty minutes. Now it takes six. This is what we changed.</p><p class="sc-p">First we measured. Half of the time was spent starting the same database again and again.</p><h2>One database</h2><p class="sc-p">We start it once and give each test a schema of its own. Nothing leaks, and it is a tenth of the work.</p><figure><img src=x><figcaption>Time by test before and after.</figcaption></figure><p class="sc-p">Then we threw away the sleeps. Every one of them hid a race.</p>]]</section></div><div class="sc-claps"><button>Clap</button><span>412</span><a href=#>Share</a></div></div><div class="sc-more"><h4>More from the author</h4><div><a href=#>Notes on queues</a><p>They fill up.</p></div><div><a href=#>Against mocks</a><p>A short rant.</p></div></div><div class="sc-upsell"><p>Get the app. Read anywhere, even offline.</p><button>Open in app</button></div></div></div></body></html>""",
    # a press notice with a boilerplate box inside and formulas
    """<html><body><nav class="c-links"><ul><li><a href=#>News</a></li><li><a href=#>Research</a></li><li><a href=#>People</a></li></ul></nav><div class="page-inner"><div class="detail">[[<h1>Smaller lenses</h1><p>A group of the institute has made a lens thinner than a hair. It bends light by ridges on its face, not by its shape.</p><p>The angle follows from <math><mi>n</mi><mo>=</mo><mn>2</mn></math> and the pitch of the ridges. The theory is thirty years old.</p>]]<div class="signup-box"><p>Want more stories like this one? Sign up for our weekly digest.</p></div>[[<p>The work was paid for by the state. The group now wants to make a lens for all colours.</p><p>It may one day sit in every telephone.</p>]]</div></div><div class="press-contact"><a href=#>Press office</a></div><footer><p>Institute of Optics, 12 Mill Lane.</p></footer></body></html>""",
]


def marked(page: str) -> tuple[str, list[str]]:
    inside = " ".join(re.findall(r"\[\[(.*?)\]\]", page, re.S))
    return page.replace("[[", "").replace("]]", ""), html.unescape(re.sub(r"<[^>]*>", " ", inside)).split()
