"""A small labelled table of page parts, and the pages that a seeded rule puts together from them.

A block of text that begins with the mark belongs to the article. All text here was written for this table.
"""

from __future__ import annotations

import random
import re

MARK = "¶"

#: Articles, one a line; @ stands for the mark, ~ for a container's attributes, which vary, % for one to sixty words
#: drawn from all articles, so that the words tell nothing.
ARTICLES = """
<h1>@Harbour bridge opens after repairs</h1><p>@The bridge over the harbour opened again on Monday, four months after cracks were found in two of its piers.</p><p>@Engineers had replaced the bearings one by one while a ferry carried people across.</p><p>@"It took longer than we hoped," the mayor said.</p>
<h1>@How to prune an apple tree</h1><p>@Wait until the leaves have fallen and the wood is dry, then remove whatever is dead or crosses another branch.</p><h2>@Tools</h2><ul><li>@A saw</li><li>@Sharp shears</li><li>@A ladder that stands firmly</li></ul><h2>@First cuts</h2><p>@Start from below. Cut back to a bud that points away from the trunk, and leave no stump behind.</p>
<h1>@Notes on a winter walk</h1><p>@Snow.</p><p>@We left the village before it was light and followed the river, which had frozen along both of its banks.</p><p>@Nobody spoke.</p><p>@At noon the sun came through and the whole valley shone like a plate, and we sat down on our bags to eat bread.</p>
<h2>@Chapter three</h2><p>@The clerk closed the book, looked at the clock over the door and saw that it had stopped a little after four.</p><p>@He wound it, as he did every evening, and went home by the longer of the two roads.</p>
<h1>@Share price falls as orders slow</h1><p>@Shares in the maker of printing machines fell by nine per cent after it reported fewer orders than analysts had expected.</p><p>@The board will propose a smaller dividend and has asked three factories to work shorter weeks until the summer.</p><p>@See also the <a href=x>annual report</a> and the <a href=x>statement of the works council</a>.</p>
<h1>@Lentil soup</h1><p>@Serves four.</p><table><tr><td>@Red lentils</td><td>@250 g</td></tr><tr><td>@Stock</td><td>@1 l</td></tr></table><p>@Rinse the lentils, bring them to the boil in the stock and let them simmer for twenty minutes, stirring now and then.</p><p>@Season with salt, lemon and a little cumin. Serve hot.</p>
<h1>@Release 4.2</h1><p>@This release mends the reader of long files and makes the index smaller by a third.</p><pre>@run --index all</pre><p>@Press the <button>Rebuild</button> key once after the update, as old indexes can not be read.</p><p>@<a href=x>Full list of changes</a></p>
<h1>@Council votes on motion</h1><div class="notice-of-motion"><p>@That this council asks the county to keep the night bus on the coast road until the railway line is open again.</p></div><p>@The motion was carried by eleven votes to seven after a debate of two hours.</p>
<h1>@What cookies taught my grandmother</h1><p>@She baked cookies every Friday of her life, and the tin stood on the shelf where no child could reach it without a chair.</p><p>@The recipe, which she never wrote down, began with a quarter of a pound of butter and ended with patience.</p>
<p>@The lake lies in a bowl of grey rock, three hours on foot from the last farm, and it has no outlet that anyone has found.</p><p>@In dry years an island rises in the middle of it, on which a chapel once stood.</p><p>@Two families of divers still come here.</p>
<h1>@Die Brücke ist wieder offen</h1><p>@Vier Monate lang mussten die Leute mit der Fähre fahren, nun ist die Brücke über den Hafen wieder für alle frei.</p><p>@Die Lager der Pfeiler wurden einzeln ersetzt.</p>
<h1>@Le pont est ouvert</h1><p>@Après quatre mois de travaux, le pont du port est de nouveau ouvert aux voitures et aux piétons depuis lundi matin.</p><blockquote>@Nous sommes contents.</blockquote><p>@Le bac ne circule plus.</p>
<h1>@Opening hours of the small museum</h1><p>@From April to October the museum is open every day except Monday.</p><p>@In winter it opens on Sundays only, and the keeper asks visitors to ring the bell twice.</p><dl><dt>@Adults</dt><dd>@4.00</dd><dt>@Children</dt><dd>@free</dd></dl>
<h1>@Review of a quiet film</h1><div><p>@For the first half hour nothing happens, and it happens beautifully: a kitchen, a kettle, rain on a roof of tin.</p></div><div><p>@Then a letter arrives.</p></div><div><p>@What the film does with that letter is the best thing I have seen on a screen this year, and I will not give it away.</p></div>
<h1>@Sources</h1><p>@The figures above come from the yearbooks of the harbour office and from letters in the city archive.</p><ol><li>@<a href=x>Yearbook of 1911</a></li><li>@<a href=x>Yearbook of 1912</a></li><li>@<a href=x>Letters, box nine</a></li></ol>
<p>@Yes.</p>
<h1>@%</h1><p>@%</p><p>@%</p>
<h1>@%</h1><p><b>@%<br>%</b><p>@%</p><p>@%</p><p>@%</p>
<p>@%</p><p>@%</p>
<h1>@%</h1><p>@%</p><ul><li>@%</li><li>@%</li></ul><p>@%</p>
<h1>@%</h1><p><b>@%<br><p>@%</p>
<h2>@%</h2><p>@%</p><p>@<a href=x>%</a> %</p>
<h1>@Form follows function</h1><p>@The phrase is older than the buildings it is blamed for.</p><figure><img src=x><figcaption>@The staircase in 1906.</figcaption></figure><p>@An architect in Chicago wrote it down in an essay on tall offices, and meant by it something nearer to biology.</p>
<h1>@Why the library keeps its sidebar of maps</h1><p>@Along the left wall of the reading room runs a narrow shelf with drawers, which the staff have called the sidebar since before the war.</p><p>@It holds nine hundred maps.</p>
"""

#: Parts that are not the article, one a line, by where they stand: t above it, b below it, i in the middle of it, e inside at its end.
AROUND = """
t<nav><ul><li><a href=x>Home</a></li><li><a href=x>News</a></li><li><a href=x>About us</a></li></ul></nav>
t<ul ~><li><a href=x>Start</a></li><li><a href=x>Products</a></li><li><a href=x>Service</a></li><li><a href=x>Contact</a></li></ul>
t<header><div>The Harbour Post</div><a href=x>Log in</a></header>
t<div class="top"><span>The Evening Paper</span> <a href=x>Subscribe</a> <a href=x>Sign in</a></div>
t<div class="ad">Fresh coffee at your door each week.</div>
t<div class="advert">Drive the new one today and pay nothing until next year at all our dealers.</div>
t<div class="ad-banner"><p>Sale ends Sunday!</p></div>
t<div ~>We use cookies to improve your experience on this website and to show you advertising. By continuing you accept our cookie policy. <a href=x>Accept</a> <a href=x>Settings</a></div>
t<div ~><p>This site uses cookies. Accept all cookies or change your consent in the privacy settings.</p></div>
t<div class="cookie-notice"><p>Cookies help us to deliver our services and you agree to them by using this page.</p></div>
t<form action=x><label>Search the site</label><input><button>Go</button></form>
t<div class="breadcrumbs"><a href=x>Home</a> &gt; <a href=x>News</a> &gt; Local</div>
t<div ~><a href=x>Home</a> / <a href=x>Archive</a> / <a href=x>March</a></div>
t<div class="notice">The archive will be closed for maintenance on Saturday evening from eight to ten.</div>
t<p ~><a href=x>Skip to content</a></p>
t<div ~>Advertisement</div>
t<div class="ad">%</div>
t<div class="ad">%</div>
t<div class="ads"><p>%</p></div>
t<div id="banner">%</div>
t<div class="cookie-consent"><p>%</p></div>
t<nav><ul><li><a href=x>%</a></li><li><a href=x>%</a></li></ul></nav>
t<header>%</header>
b<footer>%</footer>
b<footer>&copy; example.org &middot; %</footer>
b<footer>%</footer>
b<aside><p>%</p><p>%</p></aside>
b<div class="comments"><p>%</p><p>%</p></div>
b<div class="ad">%</div>
b<div ~><h3>Comments</h3><p>%</p><p>%</p></div>
b<div ~><h3>Comments</h3><p>%</p></div>
b<section ~><h3>2 comments</h3><p>%</p><p>%</p></section>
b<div ~><h4>Related</h4><p>%</p></div>
b<div class="related-links"><p>%</p></div>
i<div class="ad">%</div>
i<div class="ad-box"><p>%</p></div>
i<form><label>Name</label><input></form>
i<form><p>%</p><label>E-mail</label><input><button>Send</button></form>
e<form><label>%</label><input></form>
e<div class="comment-list"><p>%</p><p>%</p></div>
b<footer>&copy; 2024 The Harbour Post. All rights reserved.</footer>
b<footer><p>Printed by the society of friends of the harbour, who meet on the first Tuesday of each month in the old customs house.</p></footer>
b<div ~><p>&copy; Example Media Ltd. All rights reserved. <a href=x>Privacy</a> <a href=x>Terms</a> <a href=x>Imprint</a></p></div>
b<div ~><a href=x>Imprint</a> <a href=x>Privacy policy</a> <a href=x>Terms of use</a></div>
b<section class="comments"><h3>Comments</h3><div><b>Ann</b> 3 days ago<p>I walked over the bridge on the first morning and there was still wet paint on the rails, so take care.</p></div><div><b>Bob</b> yesterday<p>Nice piece, thank you.</p></div></section>
b<section ~><h3>3 comments</h3><div ~>Carla, 2 hours ago</div><p>I do not agree with a word of this, and my neighbours who read it with me do not either, to be honest.</p><div ~>Dan, 1 hour ago</div><p>Then you have not read it to the end. Reply to me when you have.</p></section>
b<div ~><h4>Comments</h4><ul><li>Great article, I shared it with all my friends at work.</li><li>First!</li><li>Does anyone know where the photograph was taken, and by whom?</li></ul></div>
b<div ~><h3>Leave a reply</h3><form><label>Your name</label><input><label>Your comment</label><textarea></textarea></form></div>
b<div class="related"><h3>Related articles</h3><ul><li><a href=x>Ferry runs for the last time</a></li><li><a href=x>Piers under the microscope</a></li></ul></div>
b<div ~><h3>You may also like</h3><p><a href=x>Ten bridges you should see before you are old</a></p><p><a href=x>What the ferryman knew</a></p></div>
b<div ~><h3>Most read</h3><ol><li><a href=x>Storm warning for the weekend</a></li><li><a href=x>Mayor to stand again</a></li></ol></div>
b<div class="newsletter"><p>Sign up for our newsletter and get the best stories of the week in your inbox every Friday.</p></div>
b<div ~><p>Subscribe to our newsletter: the stories of the week, free, in your inbox. Unsubscribe at any time.</p><form><input><button>Subscribe</button></form></div>
b<aside><h3>About the author</h3><p>She has written about harbours, trade and the sea for twenty years and lives on a boat.</p></aside>
b<div class="sidebar"><p>Weather for the coast: rain at first, clearing from the west in the afternoon.</p></div>
b<div ~><a href=x>Share</a> <a href=x>Tweet</a> <a href=x>Mail</a> <a href=x>Print</a></div>
b<div class="share-bar">Share this on your favourite network</div>
b<div class="sponsored"><p>Our partner has put together a guide to loans that you can read without any obligation.</p></div>
b<div ~><p>Sponsored: earn more on your savings with an account that takes two minutes to open.</p></div>
i<div class="ad">Boots for every kind of weather, now at half price.</div>
i<div ~><p>Advertisement</p><p><a href=x>Try the new one free for thirty days</a></p></div>
i<div class="promo"><p>Subscribers read more: try it for a month.</p></div>
i<aside><p>Read more: <a href=x>The long history of the harbour</a></p></aside>
e<div class="tags"><a href=x>bridges</a> <a href=x>harbour</a></div>
e<div class="comments"><h3>Comments</h3><p>Thanks for this, I had been wondering about the ferry for weeks and nobody would tell me.</p></div>
e<div ~><p><a href=x>Share</a> <a href=x>Print</a> <a href=x>Send</a></p></div>
e<form><label>Rate this article</label><button>Good</button><button>Bad</button></form>
"""

_ARTICLE_IN = ("<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="story">{}</div>', "<div>{}</div>", '<div class="x1">{}</div>', '<div id="share-price">{}</div>', "<div><div>{}</div></div>", "{}", "<section>{}</section>", '<article class="post">{}</article>')
_NEUTRAL = ("", "", 'class="c2"', 'id="b-17"', 'class="box"', 'class="row wide"')


def pages(n: int = 900, seed: int = 3) -> list[str]:
    """n pages: each article in turn, in a wrapper, with some parts around it in the order that pages have them."""
    rng = random.Random(seed)
    articles = [x for x in ARTICLES.split("\n") if x]
    around = [x for x in AROUND.split("\n") if x]
    words = re.sub(r"<[^>]*>|[@~%]", " ", ARTICLES).split()
    out = []

    def pick(where: str, most: int) -> list[str]:
        return [x[1:] for x in rng.sample([a for a in around if a[0] == where], rng.randrange(most + 1))]

    for k in range(n):
        body = articles[k % len(articles)]
        at = body.rfind("<p>@", 4)
        if at > 0:
            body = body[:at] + "".join(pick("i", 1)) + body[at:]
        page = "".join(pick("t", 4)) + rng.choice(_ARTICLE_IN).format(body + "".join(pick("e", 1))) + "".join(pick("b", 4))
        while "~" in page:
            page = page.replace("~", rng.choice(_NEUTRAL), 1)
        while "%" in page:
            start, size = rng.randrange(len(words)), rng.choice((2, 5, 9, 14, 20, 35, 60))
            page = page.replace("%", " ".join(words[start : start + rng.randrange(1, size + 1)]), 1)
        out.append("<html><head><title>x</title></head><body>" + page.replace("@", MARK) + "</body></html>")
    return out
