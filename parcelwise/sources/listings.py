"""Listing cards out of stored portal search pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

PAGE_CARDS_SCHEMA = "page_url STRING, portal STRING, position INT, card_address STRING, href STRING, _error STRING"

# Per portal, (tag, attribute, value) of a card, of its address and of its link.
MARKUP = {
    "rea": (("article", "class", "residential-card"), ("span", "class", "address"), ("a", "class", "details-link")),
    "domain": (("div", "data-testid", "listing-card-wrapper"), ("h2", "data-testid", "address-line1"),
               ("a", "data-testid", "listing-card-image-wrapper")),
}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def extract_cards(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Cards of pages (page_url, portal, html) in page order; address and link are those of the first
    matching element inside the card, NULL where there is none. A page that cannot be read ends there:
    the cards before stay, and a row without position has the error. Columns of the page named in
    `keep` come along."""
    keep = keep or []
    schema = ", ".join([PAGE_CARDS_SCHEMA, *[f"{c} {t}" for c, t in pages.select(*keep).dtypes]])

    def cards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, portal, html, *kept in batch.itertuples(index=False):
                found, error = _read(portal, html)
                rows += [(url, portal, i, c["address"], c["href"], None, *kept) for i, c in enumerate(found)]
                if error:
                    rows.append((url, portal, None, None, None, error, *kept))
            frame = pd.DataFrame(rows, columns=["page_url", "portal", "position", "card_address", "href", "_error", *keep])
            yield frame.astype({"position": "Int32"})

    # Dealt out first: a file of few bytes is one task's, but holds very many pages.
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.select("page_url", "portal", "html", *keep).repartition(tasks).mapInPandas(cards, schema)


def search_cards(pages: DataFrame) -> DataFrame:
    """Cards of search pages that know their suburb and postcode, ready for the listing match."""
    return extract_cards(pages, ["suburb_slug", "post_code"]).filter("position IS NOT NULL").select(
        "portal", "suburb_slug", "post_code", "position", "card_address", "href")


def _read(portal: str, html: str | None) -> tuple[list[dict], str | None]:
    if portal not in MARKUP or not html:
        return [], None
    reader = _CardReader(*MARKUP[portal])
    try:
        reader.feed(html)
        reader.close()
    except Exception as error:  # the parser gives up on some malformed declarations
        return reader.cards, f"{type(error).__name__}: {error}"
    return reader.cards, None


class _CardReader(HTMLParser):
    def __init__(self, card, address, link):
        super().__init__(convert_charrefs=True)
        self.card, self.address, self.link = card, address, link
        self.cards: list[dict] = []
        self.open: list[tuple] = []  # (tag, card begun here, cards whose address begins here)

    @staticmethod
    def _is(kind, tag, attrs) -> bool:
        wanted_tag, name, value = kind
        if tag != wanted_tag:
            return False
        given = dict(attrs).get(name) or ""
        return value in given.split() if name == "class" else value == given

    def handle_starttag(self, tag, attrs):
        inside = [card for _, card, _ in self.open if card]
        begun, addressed = None, []
        if self._is(self.card, tag, attrs):
            begun = {"address": None, "href": None, "linked": False}
            self.cards.append(begun)
        if self._is(self.address, tag, attrs):
            addressed = [card for card in inside if card["address"] is None]
            for card in addressed:
                card["address"] = ""
        if self._is(self.link, tag, attrs):
            for card in inside:
                if not card["linked"]:
                    card.update(linked=True, href=dict(attrs).get("href"))
        if tag not in VOID_TAGS:
            self.open.append((tag, begun, addressed))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        tags = [t for t, _, _ in self.open]
        if tag in tags:
            del self.open[len(tags) - 1 - tags[::-1].index(tag):]

    def handle_data(self, data):
        for _, _, addressed in self.open:
            for card in addressed:
                card["address"] += data
