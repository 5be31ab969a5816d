"""Articles whose surroundings have names of chrome."""

import pytest

from cadenza.llm.html_extract import texts_of_pages

NAV = "<nav>Home News</nav>"
P = "<h1>Title</h1><p>First words of it.</p><p>And more words.</p>"
ALL = "Title\nFirst words of it.\nAnd more words."


@pytest.mark.parametrize("body, due", [
    (f"<div class='content with-sidebar'><article>{P}</article><aside>Other</aside></div>", ALL),
    (f"<main class='content with-sidebar'><article>{P}</article></main>", ALL),
    (f"<main class='content with-sidebar'>{P}<nav>Next</nav></main>", ALL),
    (f"<div class='content with-sidebar'>{P}</div>", ALL),
    ("<article><p><span class='notice'>New:</span> the text goes on.</p><p>End.</p></article>", "New: the text goes on.\nEnd."),
    ("<article><p><span class='ad'>Buy this</span></p><p>End.</p></article>", "End."),
    ("<article><p>Text.</p><div class='related'><article>Teaser</article></div></article>", "Text."),
    (f"<article>{P}</article><div class='sidebar'><div>Links</div></div>", ALL),
    ("<nav>Menu</nav><div class='cookie'>Accept</div>", ""),
])
def test_names_around_articles(body, due):
    assert texts_of_pages([f"<html><body>{NAV}{body}<footer>Foot</footer></body></html>"]) == [due]
