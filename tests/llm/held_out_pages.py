"""Thirty pages of ten layouts, each with its article's lines: used to choose nothing in the tree.

They were written after the tree, its table and its features were final, by the same author, who knew the
word lists by then; names follow common site builders, not those lists. Other leaf sizes were tried with them in view; none was taken. Three fillings differ in length.
"""

FILLINGS = [
    ("Ferry timetable", "The ferry now leaves at seven.", "Passengers asked for years that the first crossing should be earlier, since the bakery and the clinic both open before eight and nobody could reach them in time.", "It stays so until autumn.", "In a letter to the island's paper the company wrote that it would count tickets for three months, look at the fuel bill, talk with the crew, and then decide whether an earlier boat can stay in the plan for good or whether it was a costly mistake."),
    ("Why my bread did not rise", "I blame the cold kitchen.", "After two failed loaves I put a thermometer beside the bowl and found that the room never got above fifteen degrees, which is simply too cold for the slow yeast that I use.", "The third loaf was fine.", "What helped in the end was an old trick from my aunt: warm the empty oven for one minute, switch it off, set the covered bowl inside with a cup of hot water, and leave it alone for as long as it takes to walk the dog twice around the pond and read the paper."),
    ("Release 4.2", "This version fixes a crash.", "Users who opened a project that was saved on another system could lose the window layout, because paths with spaces were cut at the first of them when the file was read again.", "Please update soon.", "We also changed how the index is built: it used to be written after each file, which took long on network drives, and is now kept in memory until the last file was read, so that a project of ten thousand files opens in a few seconds instead of several minutes on our oldest machine."),
]


def _layouts(title, short, mid, brief, long):
    noise, little = "Sign up and get ten percent off your first order when you leave us your address today.", "Open daily."
    return [
        # A blog of a common site builder.
        (f"<body class='home blog wp-custom'><div id=page class=hfeed><header id=masthead class=site-header><div class=site-title><a href=/>Notes</a></div><nav id=site-navigation><ul><li><a href=/a>About</a></li></ul></nav></header><div id=primary class=content-area><main id=main class=site-main><article id=post-7 class='post type-post'><h1 class=entry-title>{title}</h1><div class=entry-content><p>{mid}</p><p>{short}</p><p>{long}</p><p>{brief}</p></div></article><div id=comments class=comments-area><ol><li><p>{mid}</p></li></ol></div></main></div><aside id=secondary><section class=widget><h2>Archive</h2><ul><li><a href=/1>May</a></li></ul></section></aside><footer id=colophon><p>{little}</p></footer></div></body>", [title, mid, short, long, brief]),
        # Developer documentation.
        (f"<div class=wy-grid><nav class=wy-side><div class=wy-menu><ul><li><a href=1>Install</a></li><li><a href=2>First steps with it</a></li><li><a href=3>Reference</a></li></ul></div></nav><section class=wy-wrap><div class=wy-content><div role=main><h1>{title}</h1><p>{long}</p><pre>run --all</pre><p>{mid}</p><ul><li>{short}</li><li>{brief}</li></ul></div><footer><a href=n>Next</a><p>Built with a tool.</p></footer></div></section></div>", [title, long, "run --all", mid, short, brief]),
        # A newspaper.
        (f"<header class=page-head><a href=/>The Daily</a><ul><li><a href=1>Politics</a></li><li><a href=2>Sport</a></li></ul></header><div class=cols><div class=col-main><article class=story><h1>{title}</h1><p class=intro>{mid}</p><p>{long}</p><aside><h4>Read more</h4><a href=9>Another story of that day</a></aside><p>{short}</p><p>{mid}</p></article></div><div class=col-side><h3>Most read</h3><ol><li><a href=4>Storm warning for the coast</a></li><li><a href=5>Prices rise again</a></li></ol></div></div><footer><p>{noise}</p><p>Imprint</p></footer>", [title, mid, long, short, mid]),
        # A hand-made page with tables.
        (f"<html><body bgcolor=white><table><tr><td width=120><a href=i.html>Start</a><br><a href=b.html>Pictures</a><br><a href=c.html>Guest book</a></td><td><h1>{title}</h1><p>{long}<p>{mid}<p>{long}</td></tr></table><center><a href=i.html>Back</a></center></body></html>", [title, long, mid, long]),
        # An encyclopedia.
        (f"<div id=mw-head><a href=1>Log in</a> <a href=2>Talk</a></div><div id=content class=mw-body><h1>{title}</h1><div id=bodyContent><p>{long} <a href=x>Ferry</a> {short}</p><p>{mid} <a href=y>See the plan</a></p><h2>History</h2><p>{mid}</p></div></div><div id=mw-panel><ul><li><a href=3>Main page</a></li><li><a href=4>Random page</a></li></ul></div><div id=footer><ul><li>This page was last edited in May.</li><li><a href=5>Privacy policy</a></li></ul></div>", [title, f"{long} Ferry {short}", f"{mid} See the plan", "History", mid]),
        # A landing page without elements that tell.
        (f"<div class=css-1a><div class=css-2b><a href=/>Shop</a><a href=/c>Basket</a></div></div><div class=css-3c><div class=css-4d><h1>{title}</h1></div><div class=css-5e><p>{long}</p><p>{mid}</p><p>{long}</p></div></div><div class=css-6f><a href=/t>Terms</a><a href=/p>Privacy</a></div>", [title, long, mid, long]),
        # A recipe or how-to.
        (f"<main class=recipe><h1>{title}</h1><p>{mid}</p><h2>You need</h2><ul><li>{short}</li><li>Two cups</li><li>Salt</li></ul><h2>How</h2><ol><li>{mid}</li><li>{long}</li></ol><form class=rating-form><p>How did you like it?</p><label>Stars</label></form></main><section class=reader-comments><p>{mid}</p></section><footer>All rights reserved</footer>", [title, mid, "You need", short, "Two cups", "Salt", "How", mid, long]),
        # A consent wall over an article.
        (f"<div id=onetrust-consent-sdk><div role=dialog><h2>Your privacy</h2><p>We and our partners store cookies on your device and read them, to show you what suits you and to count visits.</p><button>Accept</button></div></div><div class=wrapper><article><header><h1>{title}</h1><p class=byline><a href=/w>By a writer</a></p></header><section><p>{mid}</p><p>{brief}</p><p>{long}</p></section><footer><a href=s>Share</a></footer></article></div><div class=newsletter-box><p>{noise}</p></div>", [title, mid, brief, long]),
        # A mailing list archive.
        (f"<p><a href=p>Previous message</a> <a href=n>Next message</a> <a href=t>Thread</a></p><hr><h1>{title}</h1><p>{mid}</p><p>{long}</p><p>{mid}</p><hr><p><a href=p>Previous message</a> <a href=n>Next message</a></p>", [title, mid, long, mid]),
        # A city's site with notices.
        (f"<body class='page has-banner'><div class=alert role=alert><p>The town hall is closed on Friday for the whole day, please use the desk at the station.</p></div><header role=banner><p>Town of Mill</p></header><nav aria-label=Main><a href=1>Council</a><a href=2>Waste</a></nav><main><h1>{title}</h1><p>{long}</p><p>{short}</p><h2>Contact us</h2><p>{mid}</p></main><footer role=contentinfo><p>{little}</p><a href=3>Imprint</a></footer></body>", [title, long, short, "Contact us", mid]),
    ]


PAGES = [page for filling in FILLINGS for page in _layouts(*filling)]
