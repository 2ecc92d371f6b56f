from stratalog.llm.html import main_text


def test_the_other_parts_of_an_article_are_kept():
    long, short = "<p>" + "Long part, with commas, and more. " * 9 + "</p>", "<p>" + "Shorter part, with, some, commas. " * 3 + "</p>"
    page = f'<main><article>{long}</article><article>{short}</article><article class="comment">{short}</article><nav>x</nav></main>'
    assert main_text(page).split("\n\n") == [("Long part, with commas, and more. " * 9).strip(), ("Shorter part, with, some, commas. " * 3).strip()]
    assert main_text(f"<body><article>{long}</article><div>Ads.</div></body>") == ("Long part, with commas, and more. " * 9).strip()
