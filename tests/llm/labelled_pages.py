"""Pages written by hand, each with the text a reader would call its main text. Nothing here comes from the generator."""

NEWS = """<!DOCTYPE html>
<html><head><title>Harbour bridge reopens</title><meta name="description" content="x"><script>window.dl = [1 < 2];</script></head>
<body class="home">
<div id="cookie-banner" role="dialog"><p>We use cookies to improve your visit.</p><button>Accept all</button></div>
<header class="site-header"><a href="/"><img src="l.png" alt="Daily Harbour"></a><nav><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav></header>
<main><article>
<h1>Harbour bridge reopens after two years</h1>
<p class="lead">The old bridge over the harbour opened to traffic on Monday, <em>two years</em> after it was closed for repairs.</p>
<figure><img src="b.jpg"><figcaption>The bridge on Monday morning.</figcaption></figure>
<p>Engineers had found cracks in its northern pier. The work cost 12&nbsp;million &amp; took longer than planned.</p>
<aside class="related"><h3>Related</h3><ul><li><a href="/a">Ferry timetable for spring</a></li></ul></aside>
<h2>What changes</h2>
<ul><li>Buses use the bridge again from Tuesday.</li><li>Cyclists have a lane of their own.</li></ul>
<p>Lorries above twenty tonnes must still take the tunnel.</p>
</article></main>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Finally! I have waited so long for this.</p></div></section>
<footer><p>&copy; Daily Harbour. All rights reserved.</p></footer>
</body></html>"""
NEWS_TEXT = """Harbour bridge reopens after two years
The old bridge over the harbour opened to traffic on Monday, two years after it was closed for repairs.
The bridge on Monday morning.
Engineers had found cracks in its northern pier. The work cost 12 million & took longer than planned.
What changes
Buses use the bridge again from Tuesday.
Cyclists have a lane of their own.
Lorries above twenty tonnes must still take the tunnel."""

BLOG = """<html><head><title>Sourdough</title><link rel=stylesheet href=s.css></head><body>
<div id=header><h2><a href=/>My kitchen</a></h2></div>
<div class=menu><a href=/about>About</a> <a href=/archive>Archive</a></div>
<div class="post"><h1>A sourdough that works</h1>
<p>Start the evening before. Mix 100 g of flour with as much water
and two spoons of starter.
<p>In the morning add the rest &ndash; flour, salt and water &ndash; and knead for ten minutes.
<blockquote>Good bread wants time, not yeast.</blockquote>
<p>Bake at 240 &deg;C with a bowl of water in the oven.</div>
<div class="sidebar"><h3>Popular posts</h3><ul><li><a href=/1>Rye bread</a><li><a href=/2>Pretzels</a></ul></div>
<form class="newsletter"><p>Get new recipes by mail</p><input name=mail><button>Subscribe</button></form>
<div class="footer">Powered by flour. Imprint</div></body></html>"""
BLOG_TEXT = """A sourdough that works
Start the evening before. Mix 100 g of flour with as much water and two spoons of starter.
In the morning add the rest – flour, salt and water – and knead for ten minutes.
Good bread wants time, not yeast.
Bake at 240 °C with a bowl of water in the oven."""

FORMULA = """<html><body><nav><ol><li><a href="#a">Contents</a></li><li><a href="#b">Exercises</a></li></ol></nav>
<article><h1>Circles</h1><p>The area of a circle is <math><mi>A</mi> <mo>=</mo> <mi>π</mi><msup><mi>r</mi><mn>2</mn></msup></math> for a radius r.</p>
<p>A drawing: <object data="c.svg"><svg><text>circle of radius r</text></svg></object></p>
<table><tr><th>r</th><th>A</th></tr><tr><td>1</td><td>3.14</td></tr></table></article>
<div class="advert"><p>Calculators at half price! Only this week.</p></div>
<footer>Mathematics for all</footer></body></html>"""
FORMULA_TEXT = """Circles
The area of a circle is A = πr2 for a radius r.
A drawing: circle of radius r
r
A
1
3.14"""

PLAIN = """<body><article><h1>Notice to mariners</h1><p>The light at the north mole is out of order.</p><p>Vessels are asked to keep clear.</p>
<div class="share"><a href="#">Share</a> <a href="#">Print</a></div></article><div class="comments"><ol><li><p>Thanks for the warning.</p></li></ol></div></body>"""
PLAIN_TEXT = "Notice to mariners\nThe light at the north mole is out of order.\nVessels are asked to keep clear."

LABELLED = [(NEWS, NEWS_TEXT), (BLOG, BLOG_TEXT), (FORMULA, FORMULA_TEXT), (PLAIN, PLAIN_TEXT)]
