import pytest

from graphloom.llm import op6

PAGES = [
    ("<html><head><title>x</title><body><p>text", "text"),
    ("<html><HEAD lang=en><meta charset=utf-8>\n<title>x</title><link href=a><p>one<p>two", "one\ntwo"),
    ("<head><script>'<body>'</script><style>p{}</style><title>a <p> b</title><body>text", "text"),
    ("<head><title>x</title></head><body>text</body>", "text"),
    ("<head><title>x</title><body>text</head> more", "text more"),
    ("<p>one<noscript><p>two", "one\ntwo"),
    ("<p>one<template><p>two<template>no</template> three", "one\ntwo three"),
    ("<p>one<template>no<template>no</template>no</template><noscript>no</noscript> two", "one two"),
    ("<p>one<script>no", "one"),
    ("<p>one<style>no", "one"),
    ("<header>one</header>", "one"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_omitted_end_tags(page, text):
    assert op6.plain_text(page) == text
