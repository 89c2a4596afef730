"""Pages that the tree has not seen, of sites laid out in their own ways; article blocks begin with the mark."""

from textloom.llm.labelled_pages import MARK

_PAGES = [
    """<html><head><title>Owl</title><meta charset=utf-8></head><body><div id="wrapper"><div id="masthead"><a href=/>Field Notes</a> <a href=/login>Log in</a></div>
<div id="main-column"><h1>@A barn owl at dusk</h1><div class="byline">@By a keeper of hens</div><p>@For nine evenings I waited by the gate, and on the tenth it came along the hedge without a sound.</p>
<p>@It hunted the ditch from end to end, turned, and went back over the same ground as if it had dropped something there.</p><div class="ad-slot">Binoculars from 99. Order before midnight.</div>
<p>@Then it was gone.</p></div><div id="right-rail"><h3>Latest posts</h3><ul><li><a href=1>Swifts are back</a></li><li><a href=2>On mud</a></li></ul></div>
<div id="responses"><h3>2 comments</h3><p>Lovely, I have one in my barn and it wakes the children every night in spring.</p><p>Mine left in May, sadly.</p></div>
<div id="bottom"><a href=/terms>Terms</a> <a href=/privacy>Privacy</a> &copy; 2023 Field Notes</div></div></body></html>""",
    """<body><header><nav><a href=a>Top</a><a href=b>World</a><a href=c>Sport</a></nav></header><main><article><header><h1>@Tram returns to the old town</h1><p>@Line six will run again from September.</p></header>
<p>@The council has found the money to relay two kilometres of track that were lifted in the nineteen sixties.</p><aside><p>Read more: <a href=x>A map of the line</a></p></aside><ul><li>@Six stops</li><li>@A tram every ten minutes</li></ul>
<p>@Work starts in March.</p></article><section class="related-stories"><h2>Related stories</h2><a href=1>Bus drivers vote</a><a href=2>Bridge to close</a></section></main><footer><p>Published by the Old Town Press, Mill Lane 4. All rights reserved.</p></footer></body>""",
    """<div class="cookie-banner"><p>We and our partners use cookies. <button>Accept all</button> <button>Reject</button></p></div><div class="page"><ul class="menu"><li><a href=x>Recipes</a></li><li><a href=x>Shop</a></li></ul>
<div class="recipe"><h2>@Plum cake</h2><p>@Makes one tray.</p><table><tr><td>@Flour</td><td>@300 g</td></tr><tr><td>@Plums</td><td>@1 kg</td></tr></table><p>@Halve the plums, set them in rows on the dough and bake for forty minutes until the edges are brown.</p><p>@Best on the second day.</p></div>
<div class="share-buttons"><a href=x>Share</a> <a href=x>Pin</a></div><form class="newsletter"><label>Get a recipe every week</label><input><button>Sign up</button></form></div>""",
    """<html><body><p>@In the year of the flood the mill stood still from Candlemas to Easter, and the miller, who had never had an idle week, took up the fiddle.</p><p>@He played badly.</p><p>@By midsummer he could manage three tunes, and people stopped on the bridge to listen, which had not happened while the wheel turned.</p></body></html>""",
    """<div id=top><a href=/>Docs</a> &rsaquo; <a href=/g>Guide</a> &rsaquo; Install</div><div id=toc><ul><li><a href=#1>Before you start</a></li><li><a href=#2>Steps</a></li></ul></div>
<section id=text><h1>@Install the tool</h1><h2>@Before you start</h2><p>@You need a disk with ten gigabytes free and the right to write to it.</p><h2>@Steps</h2><ol><li>@Unpack the archive.</li><li>@Run <code>setup</code> and wait until it says done.</li></ol><pre>@setup --all --quiet</pre><p>@If the last line is not shown, look into the log.</p></section>
<div id=fb><p>Was this page helpful? <button>Yes</button> <button>No</button></p></div><div id=foot>Copyright 2022. <a href=x>Privacy policy</a></div>""",
    """<table width=100%><tr><td colspan=2><a href=1>Home</a> | <a href=2>Photos</a> | <a href=3>Guestbook</a></td></tr><tr><td><p><a href=4>My links</a></p></td><td><h1>@My trip to the north</h1><p>@We took the night train and woke up beside a lake so still that the hills stood in it on their heads.</p><p>@The second day it rained, so we stayed in and played cards with the landlord, who cheats.</p></td></tr></table>""",
    """<html><body><nav>Menu</nav><div class="story-body"><h1>@Vaccine trial widened</h1><p>@The trial will take in four more hospitals after the first results were better than hoped for.</p><div class="inline-promo"><p>Sponsored: Travel insurance from 3 a day</p></div><blockquote>@We are careful people, and we are pleased.</blockquote><p>@Results are due in spring.</p></div>
<div class="comments-area"><div class="comment"><p>About time somebody did this, my mother has been waiting for two years for a place.</p></div><div class="comment"><p>Source?</p></div></div></body></html>""",
]
PAGES = [p.replace("@", MARK) for p in _PAGES]
