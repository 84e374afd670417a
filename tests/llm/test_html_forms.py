"""Forms that hold the page, and ids that are anchors."""

from veilspark.llm.html_text import main_text


def test_a_form_around_the_page_keeps_the_article():
    page = '<html><body><form id="aspnetForm" action="/x"><nav>menu</nav><article><p>One.</p><p>Two.</p></article><input value="v"><button>Go</button></form></body></html>'
    assert main_text(page) == "One. Two."
    assert main_text('<body><form id="aspnetForm"><div class="nav">menu</div><div><h1>Title</h1><p>One.</p></div></form></body>') == "Title One."


def test_forms_beside_and_in_an_article_go():
    assert main_text("<body><form><p>Log in</p><label>Name</label></form><article><p>One.</p><form><p>Vote</p></form></article></body>") == "One."
    assert main_text("<body><p>One.</p><form><p>Subscribe</p></form></body>") == "One."


def test_ids_of_headings_and_chapters_are_anchors():
    page = '<article><h2 id="comments">On comments</h2><section id="discussion"><p>Discussion of results.</p></section><p id="notice">Notice this.</p></article>'
    assert main_text(page) == "On comments Discussion of results. Notice this."
    assert main_text('<article><p>One.</p><section id="comments"><p>Nice!</p></section><div id="respond"><p>Reply</p></div><section class="discussion"><p>Me too</p></section></article>') == "One."
