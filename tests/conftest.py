import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagemill.session import build_session  # noqa: E402

#: A garden shop's shelf: a list of offers, prices in two classes, references, a quoted ">", junk.
SHELF = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>Seeds &amp; bulbs</title>
<style>li { color: green }</style><script>if (1 < 2) document.write("<li>ghost</li>");</script></head>
<body><header><a href="/">Home</a><a href="/bulbs?sort=new" rel="nofollow">Bulbs</a></header>
<main id="shelf"><ul class="offers wide" data-total-products="3">
<li class="offer first" data-sku="tu-1" data-note="tall > short"><h4>Tulip mix</h4><b class="price old">&pound;9.50</b><b class="price now">&pound;7.25</b><p>Twenty bulbs &#8212; red, white</p></li>
<li class="offer" data-sku="cr-2"><h4>Crocus &lt;early&gt;</h4><b class="price now">&#163;3.00</b><p>Flowers in March<br>or sooner</p></li>
<li class="offer sold" data-sku="sn-3"><h4>Snowdrop</h4><p>Back in autumn</p></li>
</ul></main><footer>Opening hours</footer></body></html>
"""


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "tests",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture()
def no_broadcasts(spark):
    """Any table that would be broadcast fails the query."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.fixture()
def page(spark):
    def make(*htmls, url="https://www.shop.example.com/"):
        return spark.createDataFrame(
            [(i, url, h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string"
        )

    return make


@pytest.fixture()
def shelf(page):
    return page(SHELF)
