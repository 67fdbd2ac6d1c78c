"""Pages laid out by hand, as sites of several kinds do it; the article's blocks are marked with ``@`` at their start."""

PAGES = {
    "weblog": """<!DOCTYPE html><html><head><title>Baking bread at home | Crumbs</title><style>p { margin: 0 }</style></head><body class="home single">
      <div id="page"><div id="masthead" class="site-header"><a href="/">Crumbs</a><p class="tagline">A blog on baking</p></div>
      <nav id="site-navigation"><ul><li><a href="/">Home</a></li><li><a href="/recipes">Recipes</a></li><li><a href="/about">About me</a></li></ul></nav>
      <div id="content"><article class="post-17 post hentry"><h1 class="entry-title">@Baking bread at home</h1><div class="entry-meta">Posted on <a href="/d">May 3</a> by <a href="/a">Anna</a></div>
      <div class="entry-content"><p>@Bread needs little more than flour, water, salt and time. I have baked a loaf every week for years, and it never gets dull.</p>
      <p>@Start the evening before. Mix everything in a large bowl, cover it and go to bed.</p><blockquote><p>@Time does the kneading, as my grandmother used to say.</p></blockquote>
      <p>@In the morning, shape the dough and heat the oven as far as it goes.</p></div><div class="sharedaddy">Share this: <a href="#">Twitter</a> <a href="#">Facebook</a></div></article>
      <div id="comments" class="comments-area"><h2>2 thoughts on this post</h2><ol><li><p>Lovely recipe, thank you so much! I tried it with rye flour and it worked.</p></li><li><p>How long does it keep?</p></li></ol></div></div>
      <div id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">Rolls for Sunday</a></li><li><a href="/2">Why salt matters</a></li></ul></div>
      <footer class="site-footer">Proudly made with flour. &copy; 2021 Crumbs</footer></div></body></html>""",
    "news": """<html><body><header class="topbar"><a class="logo" href="/">The Daily Gazette</a><ul class="menu"><li><a href="/world">World</a><li><a href="/city">City</a><li><a href="/sport">Sport</a></ul></header>
      <div class="cookie-banner"><p>We use cookies to improve your experience. By going on you agree to our policy.</p><button>Accept</button></div>
      <main><div class="story-body"><h1>@Council votes to keep the old bridge</h1><p class="byline">By Jo Field, city desk</p><p>@The city council voted late on Tuesday to repair the old bridge instead of replacing it, ending a debate of four years.</p>
      <aside class="related"><h4>Read more</h4><a href="/x">Bridge closed for the winter</a> <a href="/y">What a new bridge would cost</a></aside>
      <p>@Repairs will cost nine million, said the mayor, about half of what a new bridge would have cost.</p><div class="ad-slot">Advertisement: cheap flights to anywhere, book now!</div>
      <p>@Work begins in March and should end before the next winter, if the weather allows it.</p></div></main>
      <section class="newsletter-signup"><h3>Our newsletter</h3><p>Get the news in your inbox every morning.</p><form><input name="mail"><button>Sign up</button></form></section>
      <footer><ul><li><a href="/imprint">Imprint</a></li><li><a href="/privacy">Privacy</a></li></ul><p>All rights reserved. The Daily Gazette.</p></footer></body></html>""",
    "handbook": """<html><body><div class="navbar"><a href="/">Project</a> <a href="/docs">Docs</a> <a href="/blog">Blog</a></div><div class="container"><div class="sidebar toc"><ul><li><a href="#i">Install</a></li><li><a href="#c">Configure</a></li><li><a href="#r">Run</a></li></ul></div>
      <div class="document"><div class="body" role="main"><h1>@Getting started</h1><p>@This page explains how to install the program and how to run it for the first time.</p><h2>@Install</h2><p>@Download the archive and unpack it. You need about two gigabytes of free space.</p>
      <pre>@tar xf program.tar.gz</pre><ul><li>@Linux is supported from version five on.</li><li>@Other systems may work, but nobody tests them.</li></ul><h2>@Run</h2><p>@Start the program from the folder where you unpacked it. The first start takes a minute.</p></div></div></div>
      <div class="footer">Built with a generator. Last updated in June.</div></body></html>""",
    "tables": """<html><body bgcolor=white><table width=100%><tr><td colspan=2><a href=index.htm>Home</a> | <a href=links.htm>Links</a> | <a href=guest.htm>Guestbook</a></td></tr><tr><td valign=top width=120><a href=a.htm>Steam engines</a><br><br><a href=b.htm>Diesel engines</a><br><br><a href=c.htm>Railcars</a></td>
      <td><h2>@The branch line to Altdorf</h2><p>@The branch line was opened in 1878 and closed in 1969. For most of its life a single engine was enough for all its traffic.<p>@Trains stopped at five halts, of which two can still be seen today. The station of Altdorf became a restaurant.<p>@In the last years before it closed, buses took over on Sundays.</td></tr>
      <tr><td colspan=2><font size=1>Webmaster: Karl. Visitors since 1999: 12345</font></td></tr></table></body></html>""",
    "bare divisions": """<html><body><div class="x1"><div class="x2"><a href="/">Start</a></div><div class="x2"><a href="/shop">Shop</a></div><div class="x2"><a href="/help">Help</a></div></div>
      <div class="x3"><div class="x4"><div class="x5">@How we moved the whole office in one weekend</div><div class="x6">@Moving an office sounds simple until you count the cables. We had four hundred of them, and no plan.</div>
      <div class="x6">@On Friday evening everybody packed a box, wrote a name on it, and went home. On Monday morning the boxes stood on the new desks.</div><div class="x6">@What happened in between is what this text is about, and it involves a lot of coffee.</div></div></div>
      <div class="x7"><div class="x8"><a href="/j">Jobs</a></div><div class="x8"><a href="/p">Press</a></div><div class="x8">© Example Inc.</div></div></body></html>""",
    "recipe": """<html><body><nav class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/s">Soups</a> &gt; Tomato soup</nav><section class="recipe-content"><h1>@Tomato soup</h1><p>@A quick soup for cold days, ready in half an hour.</p><ul class="ingredients"><li>@800 g of ripe tomatoes, cut in halves</li><li>@one onion and two cloves of garlic</li><li>@half a litre of stock</li></ul>
      <ol><li>@Fry the onion and the garlic in some oil until they are soft.</li><li>@Add the tomatoes and the stock, and cook for twenty minutes.</li><li>@Blend, season and serve with bread.</li></ol></section>
      <div class="rating-form"><form><label>Rate this recipe</label><select><option>1<option>2<option>3</select><input type=submit></form></div><div class="recommendations"><h3>You may also like</h3><div><a href="/1">Pumpkin soup</a></div><div><a href="/2">Onion soup</a></div></div>
      <div class="subscribe-popup"><p>Don't miss a recipe! Subscribe now and get our free e-book.</p></div></body></html>""",
}
