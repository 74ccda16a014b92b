"""From fund pages to the weight table of the detection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basketflow.operators import basket as ba
from basketflow.sources import pages as pg


def weights_from_pages(pages: DataFrame) -> DataFrame:
    """Date, stock and the stock's previous volume and weight, from the pages of one fund (requested_date, html).

    Of pages that print the same date the one requested first counts.
    """
    basket = ba.clean_basket(pg.first_pages(pg.typed(pg.holdings_rows(pages))))
    composition = ba.composition(pg.typed(pg.composition_fields(pages)))
    return ba.shifted_weights(ba.basket_metrics(ba.join_composition(basket, composition)))
