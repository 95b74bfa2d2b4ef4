from keyloom.llm import html_extract as H

STORY = "<article><h1>Title</h1><p>" + "a story " * 20 + "</p></article>"
TEXT = ("Title " + "a story " * 20).strip()


def test_wrappers_keep_the_article():
    for wrapper in ('div class="layout has-sidebar"', 'div id="content-no-comments"', "form action=/", "form"):
        page = f"<body><p>Site title</p><{wrapper}>{STORY}</{wrapper.split()[0]}><p>Copyright</p></body>"
        assert TEXT in H.extract(page, None), wrapper
        plain = page.replace(STORY, "<div><p>" + "a story " * 20 + "</p></div>")
        assert ("a story " * 20).strip() in H.extract(plain, None), wrapper
    beside = STORY.replace("</article>", "<div class=comments><article>bad</article></div></article>") + "<div class=related><article>other</article></div><form>q</form>"
    assert H.extract(f"<body>{beside}</body>", None) == TEXT
    ad = "<div class=ad>" + "buy this " * 99 + "</div>"  # longer than the article beside it
    assert H.extract(f"<body>{ad}{STORY}</body>", None) == TEXT


def test_the_whole_article_around_the_winner():
    for part in ("section", "div class=body", "blockquote"):
        close = part.split()[0]
        page = f"<body><nav>n</nav><article><h1>Title</h1><p>intro</p>{f'<{part}>{"long text " * 100}</{close}>' * 2}<p>outro</p></article><div>else</div></body>"
        path = max(H.votes(page), key=lambda v: v[1])[0]
        assert path.split(":")[-1].split(".")[0] == close  # a digest of what is above, and the own step
        for given in (path, None):
            got = H.extract(page, given)
            assert got.startswith("Title intro long text") and got.endswith("long text outro") and got.count("long") == 200
