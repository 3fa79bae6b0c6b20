"""Twenty more pages by hand, written after the model file was fitted and never used to change it.

Marks as in ``pages_by_hand``.
"""

PAGES = [
    # a local paper, infobox in the middle
    """<html><head><title>Ferry returns</title></head><body><div id=top><a href=/>Harbour Herald</a><ul class=sections><li><a href=#>Local</a><li><a href=#>Tides</a><li><a href=#>Obituaries</a></ul></div>
<div class=story-wrap><h1 class=hd>[[Ferry returns after a year of repairs]]</h1><p class=byline>By Ruth Olsen, Tuesday</p><div class=body-text>[[<p>The old ferry crossed the sound again yesterday morning, with forty people and one goat on board.</p><p>She had been in the yard since last spring, when an engineer found cracks along the keel.</p>]]<div class=inline-promo><h4>Read also</h4><a href=#>Five walks along the shore</a></div>[[<p>The captain said she handled better than ever. He has steered her for twenty-two years.</p>]]</div></div>
<div class=rightcol><h3>Most read</h3><ol><li><a href=#>Cod quota cut</a><li><a href=#>School roof leaks</a></ol></div><div class=pagefoot>Harbour Herald, Quay Street 4. Subscriptions and delivery: call us.</div></body></html>""",
    # a forum thread: opening post is the article
    """<html><body><div class="navbar"><a>Boards</a><a>Members</a><a>Log in</a></div><div class="thread"><h1>[[How I fixed the rattle in my bicycle]]</h1><div class="post first-post"><div class="post-content">[[<p>After three weeks of searching I found it. The rattle came from the bell, not from the chain.</p><p>Tighten the small screw below the dome, put a rubber ring between, and it is gone for good.</p>]]</div></div><div class="comments replies"><div class="comment reply"><span>wheelie</span><p>Same here, thanks a lot.</p></div><div class="comment reply"><span>gearhead</span><p>Mine was the mudguard.</p></div></div></div><div class="footer">Powered by a forum. Terms of use. Contact us.</div></body></html>""",
    # a museum object
    """<html lang="en"><body><header class="site-header"><nav aria-label="Main"><ul><li><a href="#">Visit</a></li><li><a href="#">Exhibitions</a></li><li><a href="#">Shop</a></li></ul></nav></header><main><article class="object"><h1>[[Bronze oil lamp]]</h1><div class="object-description">[[<p>The lamp was found in a cellar near the old gate in 1898. Its handle has the form of a swimming duck.</p><p>Traces of olive oil were still in the bowl. Lamps of this kind were made in large numbers, but few are whole.</p>]]</div></article><section class="related-objects"><h2>More from this collection</h2><a href="#">Glass flask</a><a href="#">Bone comb</a></section></main><footer class="site-footer"><p>Open daily from ten to five. Closed on Mondays.</p></footer></body></html>""",
    # French blog
    """<html><body class="blog"><div class="bandeau"><a href="/">Le jardin de Lise</a></div><div class="menu-principal"><a href="#">Accueil</a> <a href="#">Potager</a> <a href="#">Contact</a></div><div class="article"><h2 class="titre">[[Semer les haricots]]</h2><div class="contenu">[[<p>On sème les haricots quand la terre est chaude, jamais avant la mi-mai. Les graines pourrissent dans un sol froid.</p><p>Je les trempe une nuit dans l'eau tiède. Le matin, je trace un sillon de trois centimètres et je les couvre légèrement.</p>]]</div></div><div class="commentaires"><h3>2 commentaires</h3><p>Merci pour ce conseil !</p><p>Chez moi cela n'a pas marché.</p></div><div class="pied">Mentions légales - Tous droits réservés</div></body></html>""",
    # German recipe list inside main
    """<html><body><header><a href=/>Omas Küche</a></header><main class="content"><article><h1>[[Kartoffelsuppe wie früher]]</h1>[[<p>Diese Suppe gab es bei uns jeden Samstag. Sie macht satt und kostet wenig.</p><ul><li>ein Kilo mehlige Kartoffeln</li><li>zwei Stangen Lauch</li><li>etwas Majoran</li></ul><p>Die Kartoffeln schälen, würfeln und mit dem Lauch weich kochen. Dann grob stampfen und mit Majoran würzen.</p>]]</article></main><aside><h4>Beliebt</h4><a href=#>Grießbrei</a><a href=#>Rote Grütze</a></aside><div class="cookie-banner"><p>Diese Seite verwendet Cookies.</p><button>Einverstanden</button></div><footer>Impressum Datenschutz</footer></body></html>""",
    # Spanish notice
    """<html><body><div id="cabecera"><h3>Ayuntamiento</h3><ul><li><a href=#>Trámites</a></li><li><a href=#>Agenda</a></li></ul></div><div id="principal"><h1>[[Corte de agua el jueves]]</h1>[[<p>El jueves por la mañana se cortará el agua en las calles del barrio alto. Los trabajos durarán unas cuatro horas.</p><p>Se recomienda llenar algunos recipientes la noche anterior. El camión cisterna estará en la plaza desde las nueve.</p>]]</div><div id="lateral"><p>Teléfonos de interés</p><a href=#>Policía local</a></div><div id="pie">Plaza Mayor, 1</div></body></html>""",
    # lecture notes
    """<html><body><div class="toc"><b>Contents</b><ul><li><a href="#1">Queues</a></li><li><a href="#2">Stacks</a></li></ul></div><div class="section"><h1>[[Queues]]</h1>[[<p>A queue hands out what came in first. Think of people who wait for bread.</p><p>It has two operations: one puts an item at the end, the other takes the item at the front.</p><pre>push(q, x)
x = pop(q)</pre><p>Both take constant time if the items are linked.</p>]]</div><div class="navigation"><a href="#">previous</a> <a href="#">next</a> <a href="#">index</a></div><div class="footer">Last modified in March.</div></body></html>""",
    # product review
    """<html><body><div class="hdr"><img src=l.png><a href=#>Phones</a><a href=#>Cameras</a><a href=#>Deals</a></div><div class="review-page"><h1 class="review-title">[[A small camera with a big heart]]</h1><div class="review-body">[[<p>It weighs less than an apple and fits in a coat pocket. After two weeks I did not want to give it back.</p><p>Pictures are sharp in the middle and a little soft at the edges. Colours are warm, sometimes too warm.</p><h3>Battery</h3><p>A charge lasts for about three hundred pictures, which was enough for a day in the hills.</p>]]</div><div class="buy-box"><p>Best price today</p><a class="btn">Buy now</a></div></div><div class="user-comments"><p>wanderer: Does it take the old lenses?</p></div><footer class="ft">We may earn a commission when you buy through links.</footer></body></html>""",
    # science news with figure
    """<html><body><nav class="top-nav"><a href=#>Space</a><a href=#>Health</a><a href=#>Earth</a></nav><div class="layout"><div class="main-col"><h1>[[Moss that drinks fog]]</h1><div class="article__body">[[<p>High on the ridge it hardly ever rains, yet the moss is green all year. A team has now found out how it drinks.</p><figure><img src=m.jpg><figcaption>The moss at dawn, heavy with drops.</figcaption></figure><p>Tiny hairs on the leaves catch fog and lead the water to the stem. A square metre takes up half a litre in a night.</p>]]</div></div><div class="side-col"><div class="widget newsletter"><h3>Weekly letter</h3><form><input><button>Join</button></form></div></div></div><div class="legal">Copyright. All rights reserved.</div></body></html>""",
    # a poem
    """<html><body><p><a href=index.html>back to the list</a></p><div class=poem><h2>[[Low tide]]</h2>[[<p>The boats lie on their sides and wait,<br>the gulls walk where the water was,<br>a child has found a rusty gate<br>and swings it, and it has no cause.</p>]]</div><p class=small>Printed with leave of the author.</p></body></html>""",
    # company news
    """<html><body><div class="header-wrapper"><a class="logo">Nordwind</a><div class="mega-menu"><a>Products</a><a>Investors</a><a>Careers</a></div></div><section class="news-detail"><h1>[[New wind farm goes on line]]</h1><div class="rich-text">[[<p>Nordwind has connected twelve turbines off the west coast to the grid. They will supply about thirty thousand homes.</p><p>Work began three years ago and was finished two months before the date that had been set.</p>]]</div><div class="share-buttons"><a>Print</a><a>Mail</a></div></section><section class="more-news"><h2>More news</h2><a>Results of the third quarter</a><a>Change in the board</a></section><div class="footer-wrapper"><a>Imprint</a><a>Accessibility</a></div></body></html>""",
    # travel diary, old
    """<HTML><BODY><CENTER><H3>My Travels</H3><A HREF=1.htm>1997</A> | <A HREF=2.htm>1998</A></CENTER><HR>[[<H2>Day four: over the pass</H2><P>We left before sunrise, since the bus was said to be early. It was two hours late.<P>At the top there was snow, and a man who sold hot milk from a bucket. We drank three cups each.<P>The road down has sixty bends. I counted them, so as not to look.]]<HR><I>Visitors since 1998: 10234. Sign my guest book!</I></BODY></HTML>""",
    # FAQ page
    """<html><body><div class="site-nav"><a>Home</a><a>Plans</a><a>Support</a></div><div class="faq"><h1>[[Questions about your library card]]</h1>[[<h3>How long is it valid?</h3><p>A card is valid for one year from the day it was made. You can renew it at the desk.</p><h3>What if I lose it?</h3><p>Tell us at once, so that nobody else can borrow books in your name. A new card costs five.</p>]]</div><div class="chat-widget"><p>Hello! How can we help you?</p><button>Start chat</button></div><div class="bottom-bar">Library of the city</div></body></html>""",
    # interview
    """<html><body><header class="masthead"><a href=/>The Fiddle</a><nav><a>Reviews</a><a>Events</a></nav></header><article class="interview"><header><h1>[[I still practise every day]]</h1><p class="kicker">Interview</p></header><div class="text">[[<p>She has played for sixty years and still tunes by ear. We met in her kitchen, where the violin hangs beside the pans.</p><p><b>Do you ever rest?</b></p><p>On Sundays. But then I hum, and my fingers move on the table.</p><p><b>What do you tell your pupils?</b></p><p>To play slowly, until it is dull. Then it begins to be music.</p>]]</div></article><div class="subscribe-overlay"><p>You have two free articles left this month.</p><a>Subscribe</a></div><footer>Contact Advertise</footer></body></html>""",
    # changelog
    """<html><body><div class="sidebar-nav"><ul><li><a>Overview</a></li><li><a>Changes</a></li><li><a>Download</a></li></ul></div><div class="document">[[<h1>Changes in version 3</h1><p>The parser was written anew and is about twice as fast. Files with mixed line ends are now read as they should be.</p><ul><li>The option for quiet runs also hides warnings.</li><li>Dates before 1900 no longer lead to an error.</li></ul><p>Many thanks to all who sent reports.</p>]]</div><div class="related"><a>previous</a><a>next</a></div><div class="copyright">Built with a generator.</div></body></html>""",
    # event page
    """<html><body><div class="topbar"><a>Tickets</a><a>Programme</a></div><div class="event"><h1>[[Night of the choirs]]</h1><div class="event-text">[[<p>Eleven choirs from four towns sing in the old tram depot. The doors open at six, and the last song ends at midnight.</p><p>Bring a coat, as the hall is not heated. Soup and tea are sold at the entrance.</p>]]</div><div class="ticket-form"><form><label>Number of tickets</label><input><button>Order</button></form></div></div><div class="sponsors"><h4>With the support of</h4><img src=a.png><img src=b.png></div><div class="footer">Town hall, culture office</div></body></html>""",
    # encyclopaedia in Spanish
    """<html><body><div class="barra"><form><input><button>Buscar</button></form></div><div class="contenido"><h1 class="encabezado">[[Molino de viento]]</h1><div class="cuerpo">[[<p>Un molino de viento es una máquina que aprovecha la fuerza del aire para moler grano o sacar agua. Los más antiguos tenían velas de tela.</p><p>En la llanura se construyeron cientos de ellos. Hoy quedan unos pocos, y casi todos se pueden visitar.</p>]]</div></div><div class="herramientas"><ul><li><a>Lo que enlaza aquí</a></li><li><a>Versión para imprimir</a></li></ul></div><div class="aviso-legal">El texto está disponible bajo una licencia libre.</div></body></html>""",
    # help article with breadcrumbs and votes
    """<html><body><div class="crumbs"><a>Help</a> / <a>Printing</a></div><div class="help-article"><h1>[[The printer prints blank pages]]</h1>[[<p>First look at the cartridge. A strip of tape may still cover the nozzle, above all when it is new.</p><ol><li>Take the cartridge out and remove the tape.</li><li>Put it back until it clicks.</li><li>Print a test page.</li></ol><p>If the page is still blank, clean the head twice and wait for ten minutes.</p>]]<div class="was-this-helpful"><p>Was this article helpful?</p><button>Yes</button><button>No</button></div></div><div class="see-also"><h3>See also</h3><a>Paper jams</a></div><div class="foot">Service centre</div></body></html>""",
    # opinion, nested divs without names
    """<html><body><div><div><a href=#>front page</a><a href=#>opinion</a><a href=#>archive</a></div><div><div><h1>[[In praise of slow trains]]</h1>[[<div>The fast line takes two hours and shows you nothing but walls. The slow one takes five and shows you a country.</div><div>You see the washing, the dogs, the men who lean on gates. You learn where the rain begins.</div><div>I have never met anyone on a fast train. On the slow one I met my wife.</div>]]</div><div><a href=#>More by this author</a></div></div><div>Letters to the editor are welcome. Please give your full name.</div></div></body></html>""",
    # French institution with accessibility links
    """<html lang="fr"><body><ul class="acces-rapide"><li><a href="#c">Aller au contenu</a></li></ul><header><a href="/">Observatoire</a><nav><a>Actualités</a><a>Recherche</a></nav></header><main id="c"><h1>[[Une comète visible à l'œil nu]]</h1><div class="texte">[[<p>Une comète passera près de la Terre dans la nuit de samedi. On pourra la voir sans instrument, bas sur l'horizon, vers l'ouest.</p><p>Sa queue mesure plusieurs millions de kilomètres. Elle ne reviendra que dans quatre mille ans.</p>]]</div><div class="partage"><span>Partager</span><a>Imprimer</a></div></main><aside class="agenda"><h2>Agenda</h2><p>Visite guidée le dimanche.</p></aside><footer><p>12, rue du Dôme</p></footer></body></html>""",
]
