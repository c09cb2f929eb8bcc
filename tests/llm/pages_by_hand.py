"""Twenty-two pages written and labelled by hand, in the layouts of as many kinds of site. Blocks of main text begin with a plus sign, which is taken
out; their class names are none of those that the operator's training pages use."""

PAGES = [
    # a daily paper
    '<div class="masterline"><b>The Courier</b></div><ul class="rubrics"><li><a href="/w">World</a><li><a href="/b">Business</a><li><a href="/s">Sport</a></ul><article class="leadpiece"><h1>+Bridge opens after nine years</h1><p>+The crossing was finished on Friday, two years later than planned, and the first cars went over it at noon.</p><p>+Engineers said the delay came from the ground, which was softer than the tests had shown.</p><blockquote>+We had to start again twice.</blockquote></article><div class="alsoread"><h4>Read on</h4><ul><li><a href="/1">Ferry fares rise</a><li><a href="/2">New rail line</a></ul></div><footer><p>Printed in three cities</p></footer>',
    # a cooking diary
    '<header><a href="/">Plain Plates</a></header><div class="recipe-wrap"><h1>+Lentil soup</h1><p>+This is the soup I make when it rains, and it takes half an hour from start to finish.</p><ul><li>+Two cups of lentils<li>+One onion, chopped<li>+A spoon of cumin.</ul><ol><li>+Fry the onion in oil until it is soft.<li>+Add the rest and a litre of water, and let it cook for twenty minutes.</ol><p>+Serve with bread.</p></div><section class="visitors-say"><h3>What visitors say</h3><div><p>Made this last night, lovely!</p></div><div><p>I used less salt.</p></div></section><footer>&copy; Plain Plates</footer>',
    # documentation
    '<nav><ul><li><a href="#a">Install</a><li><a href="#b">Use</a><li><a href="#c">Options</a></ul></nav><main><h1>+Installing the tool</h1><p>+Download the archive for your system and unpack it anywhere you like.</p><pre>+tool --version</pre><h2>+Options</h2><table><tr><th>+Flag<td>+Meaning of the flag<tr><th>+-q<td>+Print less.</table></main><footer><p>Edit this page</p></footer>',
    # a forum's first message
    '<div class="crumbline"><a href="/">Start</a> <a href="/g">Gardening</a></div><article><h1>+Yellow leaves on my tomato</h1><p>+The lower leaves of my tomato have turned yellow within a week, though I water it every evening.</p><p>+It stands on a balcony that faces south. What could it be?</p></article><section class="thread-answers"><article><p>Too much water, I would say.</p></article><article><p>Mine did that too.</p></article></section><form><label>Your answer</label><textarea>Write here</textarea><button>Send</button></form>',
    # an encyclopaedia
    '<div id="globe-corner"><a href="/">Free Reference</a></div><main id="lemma"><h1>+Heron</h1><p>+Herons are long-legged birds that live near fresh water and along coasts, on every continent but one.</p><h2>+Feeding</h2><p>+They stand still in shallow water and strike at fish with a sudden thrust of the neck.</p><figure><img src="h.jpg"><figcaption>+A grey heron at a pond.</figcaption></figure></main><nav><a href="/r">Random page</a> <a href="/h">Help</a></nav><footer><p>Text may be used under its licence.</p></footer>',
    # a shop's product
    '<header><a href="/">Boots &amp; Co</a><form><input name=q><button>Find</button></form></header><main><h1>+Walking boot, brown</h1><p>+A boot of full leather with a stitched sole that can be replaced, made for long days on stony paths.</p><ul><li>+Weight of a pair: 1.4 kg.<li>+Sizes from 36 to 48.</ul></main><aside><h3>Others bought</h3><ul><li><a href="/l">Laces</a><li><a href="/w">Wax</a></ul></aside><footer><a href="/t">Terms</a> <a href="/p">Privacy</a></footer>',
    # a press release
    '<div class="corp-strip"><a href="/">Norden Energy</a></div><article><h1>+Norden Energy names new chair</h1><p>+The board of Norden Energy has chosen Karin Holm as its chair from the first of May.</p><p>+She follows Per Lund, who has led the board for eleven years and leaves at his own wish.</p><p>+About Norden Energy: the company runs forty wind farms in six countries.</p></article><footer><p>Imprint</p><p>Privacy</p></footer>',
    # a law text
    '<nav><ol><li><a href="#1">Part one</a><li><a href="#2">Part two</a></ol></nav><main><h1>+Act on small boats</h1><h2>+Section 1</h2><p>+A boat of under six metres may be sailed without a licence on inland waters.</p><h2>+Section 2</h2><p>+The owner shall see to it that a vest is carried for every person on board.</p></main><footer><p>Ministry of Transport</p></footer>',
    # a travel report with an offer inside
    '<header><h2>Far &amp; Slow</h2></header><article><h1>+Three days on the ferry</h1><p>+The ship left at dusk and the town sank behind us until only its lighthouse was left.</p><div class="adbox">Cheap cabins from 39 euros, book today!</div><p>+On the second morning we saw ice for the first time, thin plates that rang against the hull.</p><p>+Nobody slept much after that.</p></article><section id="comments"><h3>Three voices</h3><div class="comment"><p>Great trip!</p></div></section><footer><p>Far &amp; Slow 2023</p></footer>',
    # a school's news
    '<div class="schoolhead"><a href="/">Hill School</a></div><nav><a href="/y">Years</a> <a href="/t">Term dates</a></nav><main><h1>+Sports day moves to June</h1><p>+Because the field is being drained, sports day will be on the ninth of June this year.</p><p>+Parents are welcome from ten in the morning; lunch can be bought at the hall.</p></main><footer><p>Hill School, Mill Lane</p></footer>',
    # a poem
    '<header><a href="/">Verse Every Day</a></header><article><h1>+The Mill</h1><p>+The wheel has turned since morning light,<br>and grinds what summer grew.</p><p>+It will be turning still tonight<br>when I have gone from you.</p></article><nav><a href="/p">Yesterday</a> <a href="/n">Tomorrow</a></nav><footer><p>One poem a day</p></footer>',
    # a cookie wall before the text
    '<div class="cookie-layer"><p>This site stores data on your device. Choose what you allow.</p><button>All</button><button>None</button></div><main><h1>+How glass is made</h1><p>+Sand, soda and lime are melted at about fifteen hundred degrees until the bubbles have risen.</p><p>+The melt is poured on a bath of tin, on which it spreads out flat.</p></main><footer><p>Made with care</p></footer>',
    # an interview
    '<header><a href="/">Stage</a></header><article><h1>+I never liked rehearsals</h1><p>+The actor Mira Sol has played forty parts. We met her in the empty theatre.</p><p>+Do you still get nervous?</p><p>+Always. If I am not, something is wrong.</p><p>+And afterwards?</p><p>+Afterwards I am hungry.</p></article><aside><p>Tickets for the season are on sale now.</p></aside><footer><p>Stage is a magazine.</p></footer>',
    # a changelog
    '<nav><ul><li><a href="/d">Downloads</a><li><a href="/f">Forum</a></ul></nav><main><h1>+Version 4.2</h1><ul><li>+Opening large files is twice as fast.<li>+The window keeps its place after a restart.<li>+Fixed: a crash when the disk was full.</ul></main><footer><p>&copy; the makers</p></footer>',
    # an obituary with a form after it
    '<header><a href="/">Valley Times</a></header><article><h1>+Ada Brook, 1931 to 2022</h1><p>+Ada Brook, who taught three generations of the valley to read, died on Sunday at her home.</p><p>+She leaves two sons and a library of nine thousand books.</p></article><form><label>Light a candle</label><input name=n><button>Light</button></form><footer><p>Valley Times, since 1888</p></footer>',
    # minutes of a meeting
    '<div class="towncrest"><a href="/">Town of Elm</a></div><main><h1>+Minutes of the council, 4 March</h1><p>+Present were the mayor and eleven members; two sent their apologies.</p><ol><li>+The minutes of February were approved.<li>+The budget for the bath was raised by nine thousand.<li>+The next meeting is on the first of April.</ol></main><aside><h3>Offices</h3><p>Open on weekdays from nine.</p></aside><footer><p>Town of Elm</p></footer>',
    # a film review with tags after it
    '<nav><a href="/n">New</a> <a href="/c">Classics</a></nav><article><h1>+A film that waits</h1><p>+For the first half hour nothing happens, and one would not miss a minute of it.</p><p>+Then a door opens, and the film becomes another one altogether.</p></article><div class="tags"><a href="/t/1">drama</a> <a href="/t/2">slow</a></div><footer><p>Reel Notes</p></footer>',
    # a science note with a sign-up box inside
    '<header><a href="/">Small Science</a></header><article><h1>+Why bees dance</h1><p>+A bee that has found flowers tells the others where they are by walking in a figure of eight.</p><div class="newsletter"><h3>A letter every week</h3><p>Leave your address and we write to you.</p></div><p>+The angle of the middle line gives the direction, and its length the distance.</p></article><footer><p>Small Science is free.</p></footer>',
    # an old page of tables
    '<table><tr><td>+Our club was founded in 1952 by six friends who liked to sail.<tr><td>+Today it has two hundred members and a house at the lake.</table><footer><p>Webmaster: Jon</p></footer>',
    # a job offer
    '<header><a href="/">Work Here</a><nav><a href="/l">List</a></nav></header><main><h1>+Baker, full time</h1><p>+We look for a baker who likes early mornings and works well with others.</p><ul><li>+You have finished your training.<li>+You can start in autumn.</ul><p>+Write to us before the end of July.</p></main><footer><p>Imprint</p></footer>',
    # an entry behind a bar that is not closed properly
    '<nav><ul><li><a href="/1">One<li><a href="/2">Two</ul></nav><main><h1>+On writing by hand<p>+I took it up again last winter, when the power was out for a week.<p>+It is slower, and that seems to be the point of it.</main><section class="comments"><p>So true.</p></section>',
    # a weather report
    '<div class="wxbar"><a href="/">Weather Desk</a></div><article><h1>+Rain from the west by evening</h1><p>+The morning stays dry in most places, with some fog along the river until ten.</p><p>+In the afternoon clouds come in from the west, and it rains from about six.</p></article><aside class="sidebar"><h3>Cities</h3><ul><li><a href="/a">Aston</a><li><a href="/b">Burle</a></ul></aside><footer><p>Weather Desk</p></footer>',
]
