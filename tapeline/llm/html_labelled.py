"""Labelled pages that the main-text weights are learned from: elements marked data-main hold the main text, all else is around it.

The pages were written for this purpose in the layouts that sites commonly have: articles, recipes, forums,
manuals, shops, tables as layout, pages without classes, and pages in several languages.
"""

PAGES = (
    """<html><head><title>A</title></head><body><header class="site-header"><a>Home</a> Our daily paper</header><nav class="menu"><ul><li><a>News</a></li><li><a>Sport</a></li></ul></nav>
    <div class="ad">Buy cheap shoes today</div><article data-main><h1>Rain floods the valley</h1><p>Heavy rain fell over the valley on Monday and the river left its bed.</p><p>Nobody was hurt, said the mayor, though many roads stay closed.</p>
    <ul><li>Roads are closed</li><li>Schools are open</li></ul></article><aside class="sidebar"><h3>Most read</h3><p>Ten ways to save money on food.</p></aside><footer>&copy; 2020 The paper. All rights reserved.</footer></body></html>""",
    """<body><div id="header"><div class="logo">Cook book</div></div><div id="nav"><a>Soups</a> | <a>Cakes</a> | <a>About</a></div><div id="cookie-notice">We use cookies to make this site better. <a>Accept</a></div>
    <div id="main"><div class="post-content" data-main><h2>Bread without effort</h2><p>Mix flour, water, salt and a little yeast in the evening.</p><blockquote>Patience does the work.</blockquote><p>In the morning fold the dough, let it rest and bake it hot.</p></div>
    <div class="share social">Share this on every network</div><div id="comments"><h3>Comments</h3><div class="comment"><p>I tried it and it is very good bread.</p></div><form><label>Your name</label><input><button>Send</button></form></div></div>
    <div id="sidebar" class="widget"><h4>Newsletter</h4><p>Sign up to get our letters.</p></div><div id="footer">Contact, terms and privacy</div></body>""",
    """<body><div class="topbar navigation">Login Register Help</div><main><section class="article-body entry" data-main><h1>On old clocks</h1><p>A clock that stands still is right twice a day.</p><p>The one in our hall has stood since the winter of the great snow.</p></section>
    <section class="related"><h2>Related stories</h2><a>On new clocks</a><a>On watches</a></section><div class="advert banner sponsored">Sponsored: sell your gold now</div></main><footer class="copyright">Printed by us</footer></body>""",
    """<body><nav class="breadcrumb"><a>Home</a> / <a>Travel</a></nav><div class="alert notice popup">This site needs scripts.</div><article data-main><h1>Two days in the hills</h1><p>The first day we walked up through the woods until dusk.</p><table><tr><td>Miles</td><td>Twelve</td></tr></table>
    <p>The second day we walked down again, slower than before.</p></article><div class="ads">Cheap flights here</div><section class="comments reader-comments"><p>Lovely walk, we did it last year.</p></section><form class="subscribe">Enter your mail address</form><footer>All texts are ours. <a>Imprint</a></footer></body>""",
    """<body><article><header><h1 data-main>The last ferry</h1></header><p data-main>The last ferry left the island at nine in the evening.</p><div class="ad advert">Insure your boat with us today and save</div><p data-main>Those who missed it slept in the old school.</p>
    <aside class="related">Read also: the first ferry of the year</aside><p data-main>In the morning the sea was calm again.</p><nav class="pager menu"><a>Next page</a></nav><form class="newsletter">Get our letters every week</form><div class="comments"><p>We were there too that night.</p></div><footer>Filed under islands</footer></article></body>""",
    """<body><article><h2 data-main>A garden in spring</h2><div class="notice cookie banner">Our pages keep cookies on your machine</div><div data-main><p>Sow peas as soon as the soil is dry.</p><p>Beans wait until May.</p></div><div class="ads sponsored">Seeds at half the price</div><aside class="sidebar"><p>Our shop is open on Sunday.</p></aside>
    <section class="comments"><div class="comment"><p>My peas never grow at all.</p></div></section><div class="share social">Tell your friends</div><form><p>Write a comment below</p></form><footer class="footer"><p>Written by the gardener</p></footer></article></body>""",
    """<html><body><nav><ul><li><a>Start</a></li><li><a>Politik</a></li><li><a>Kultur</a></li><li><a>Wetter</a></li></ul></nav><div class="ad">Jetzt Strom wechseln und sparen</div><article data-main><h1>Neue Br&uuml;cke er&ouml;ffnet</h1><p>Am Samstag wurde die neue Br&uuml;cke &uuml;ber den Fluss er&ouml;ffnet.</p>
    <p>Der Bau hat vier Jahre gedauert und viel Geduld verlangt.<br>Im Herbst soll auch der Radweg fertig sein.</p></article><footer>&copy; Tageblatt &middot; Impressum und Datenschutz</footer></body></html>""",
    """<html><body><div role="banner" class="masthead">Le Courrier du soir</div><div role="navigation"><a>Accueil</a><a>Monde</a><a>Sports</a></div><div class="consent overlay">Nous utilisons des cookies pour mesurer l'audience. <button>J'accepte</button></div>
    <div role="main"><div class="story" data-main><h1>Le march&eacute; revient place du Th&eacute;&acirc;tre</h1><p>Apr&egrave;s deux ans de travaux, les mara&icirc;chers ont retrouv&eacute; la place.</p><ol><li>Le mardi matin</li><li>Le samedi toute la journ&eacute;e</li></ol><p>Les riverains s'en r&eacute;jouissent, les commer&ccedil;ants aussi.</p></div>
    <div class="promo">Abonnez-vous pour un euro</div></div><div role="complementary">Les plus lus de la semaine</div><div role="contentinfo">Mentions l&eacute;gales</div></body></html>""",
    """<body><table><tr><td colspan="2">Radio club pages</td></tr><tr><td class="menu"><a>Home</a><br><a>Members</a><br><a>Links</a></td><td data-main><h3>Building a crystal set</h3>A crystal set needs no battery at all.<br><br>Wind eighty turns of wire on a tube, and tap it every tenth turn.<p>The aerial should be as long and as high as the garden allows.</td></tr>
    <tr><td colspan="2" class="footer">Webmaster, last change in May</td></tr></table></body>""",
    """<body><div class="navbar"><a>Docs</a><a>Blog</a><a>Download</a></div><div class="toc sidebar"><ul><li><a>Install</a></li><li><a>Configure</a></li></ul></div><div class="document" data-main><h1>Configure the server</h1><p>All settings live in one file that is read at the start.</p><pre>port = 8080
workers = 4</pre><dl><dt>port</dt><dd>where the server listens</dd><dt>workers</dt><dd>how many requests it serves at a time</dd></dl><p>Restart the server after each change.</p></div><div class="footer-links">Edit this page on the tracker</div></body>""",
    """<body><div class="header"><span class="brand">Garden forum</span> <form class="search"><input> Search the forum</form></div><div class="thread"><h1 data-main>Which apple keeps longest?</h1><div class="post" data-main><p>I am looking for an apple that keeps until April in a cool cellar.</p><p>We have clay soil and late frosts.</p></div>
    <div class="replies comments"><div class="comment"><p>Try a russet, ours kept until May.</p></div><div class="comment"><p>Wrap each one in paper.</p></div></div></div><div class="pagination"><a>1</a><a>2</a><a>3</a></div><div class="bottom footer">Rules of the forum</div></body>""",
    """<body><div class="top-menu menu"><a>Shop</a><a>Basket</a></div><main class="content"><h1 data-main>Hand plane number four</h1><section class="description" data-main><p>A smoothing plane for the last strokes before the oil.</p><p>The iron is two inches wide and takes a keen edge.</p><figure><img><figcaption>The plane on a bench of beech.</figcaption></figure></section>
    <div class="recommendations related"><h2>Others bought</h2><p>Whetstones and strops</p></div><div class="reviews comments"><h2>Reviews</h2><p>Arrived quickly, works well.</p></div></main><div class="newsletter signup"><p>Ten percent off your first order</p></div><footer><p>Delivery and returns</p></footer></body>""",
    """<body><a>Index</a> <a>Next</a><h1 data-main>Chapter the third</h1><p data-main>It was not until the lamps were lit that anybody thought of the boy.</p><p data-main>He had been sent to the mill at noon, and the mill was not an hour away.</p><p data-main>His mother stood at the gate and said nothing.</p><hr><a>Back to the shelf</a></body>""",
    """<body><div id="menu"><ul><li><a>Inicio</a></li><li><a>Recetas</a></li></ul></div><div id="contenido"><div class="entry-content" data-main><h2>Sopa de ajo</h2><p>Se fr&iacute;en los ajos en buen aceite hasta que est&eacute;n dorados.</p><ul><li>Cuatro dientes de ajo</li><li>Pan del d&iacute;a anterior</li></ul><p>Se a&ntilde;ade el caldo y se deja hervir un cuarto de hora.</p></div>
    <div class="publicidad ad">Sartenes al mejor precio</div><div class="comentarios comments"><p>La hice ayer y estaba muy rica.</p></div></div><div id="pie" class="footer">Aviso legal</div></body>""",
    """<body><header><h2>Village news</h2><nav><a>Archive</a></nav></header><section><h1 data-main>Choir sings in the barn</h1><div class="byline meta">By our reporter</div><p data-main>The choir sang in the old barn because the church roof leaks.</p><p data-main>It was cold, and full to the last seat.</p><div class="warning notice">You have read three of five free stories.</div><p data-main>The money goes to the roof.</p><div class="tags">choir, barn, roof</div></section><footer>Printed weekly</footer></body>""",
    """<body><div class="nav menu"><a>Front</a><a>Opinion</a></div><article data-main><h2>The well on the green</h2><div>The well on the green has been dry since the summer before last.</div><div>Now the council has voted to dig it deeper, by eleven voices to four.</div><div>Work begins after the harvest.</div></article><div class="sponsor ad">A word from our sponsor</div><div class="foot footer">The village sheet</div></body>""",
    """<body><nav><a>All notes</a></nav><main><article data-main><div><span>Notes of a walk along the canal, from lock to lock.</span></div><div>At the second lock a heron stood and did not mind us.</div><section><div>At the third the keeper's house is empty.<br>Somebody has planted leeks there all the same.</div></section></article></main><aside><div>Older notes</div></aside><footer><div>Licence and imprint</div></footer></body>""",
)
