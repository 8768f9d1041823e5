"""Small inline inputs for scalar and document operators, shared by queries, their SQL and tests."""

from __future__ import annotations

import json

PRICES = [
    "2.340.000", "2,340,000", "480.000₫", "480.000 đ", "2.340.000 VND", "2 340 000", "480000", "2.340.00", "3.5", "3,5", "480k", "2tr3", "98.76.543", "",
    "Liên hệ", "2.340.000₫ - 5.100.000₫", "-480.000", "617000.00", "2.340.000,50", "2.340,000", "S$700", "480.000 vnđ", "$700", "300 USD 8 EUR", "€ 1.874,95", "1.2,3 4", "#12", "  ",
]
NUMBERS = ["259000.00", "1.250.000", "", "0", "12", "007.5", "-3", "1e5", " 42 "]
COUNTS = ["1.234", "abc", "4.5", "1,000", " 7 ", "", "12 345"]
RATINGS = ["4.5", "4,5", "9", "5", "0", "4.567", "x", "", "5.0", "10"]
URLS = [
    "https://shop.example/", "shop.example", "https://shop.example/collections/mats", "https://shop.example/product-category/mats/", "https://shop.example/danh-muc/tham",
    "https://shop.example/products/mat-1", "https://shop.example/san-pham/tham-1", "https://shop.example/mat-p123.html", "https://shop.example/p/77", "https://shopee.vn/brand",
    "https://www.lazada.vn/shop/brand", "https://shopee.vn/mat-i.1.2", "https://www.amazon.com/dp/B00ABC123", "https://shop.example/blog/post", "ftp://shop.example/x", "not an address",
    "HTTPS://Shop.Example:443/products/x#top", "https://user:pass@shop.example/a//b/?utm_source=x&page=2&gclid=1", "//cdn.example/x", "http://localhost:8080/a/", "https://shop.example/?q=a&&fbclid=2&sort=asc",
]
RESOLVE = [(base, href) for base in ("https://shop.example/a/b/c.html", "https://shop.example", "bad base") for href in ("/products/y", "../d", "./e", "f", "//cdn.example/x", "https://o.example/z", "javascript:void(0)", "#top", "?p=2", "", "../../../../g", "mailto:a@b.example")]
PASTED = ["https://a.example/x?utm_source=1\nhttps://a.example/x, bad;https://b.example/", "  https://a.example/x/  "]
HTML = [
    "<p>a &amp; b &lt;c&gt; &#65;&#x42; &nbsp;d&eacute;</p>", "<script>var x='<p>';</script><p>shown</p><!-- hidden --><style>p{}</style>", "<h1> First <b>one</b></h1><title>t</title>", "<title>Only &quot;t&quot;</title>", "", "<div id=\"root\"></div>",
    "&amp;lt; &#38;#65; &#x1F600; &#0; &hellip;", "<noscript>no</noscript><a href='/x'>link &ndash; one</a><a href=\"\">none</a><A HREF=/y>two</A>",
]
ROBOTS = [
    ("https://a.example", "User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 2\nSitemap: https://a.example/s.xml\n"),
    ("https://b.example", "User-agent: shelf\nUser-agent: other\nDisallow: /*.pdf$\nDisallow: /x*y\nAllow:\n\nUser-agent: *\nDisallow: /\n"),
    ("https://c.example", "# nothing here\nDisallow: /early\nUser-agent: nobody\nDisallow: /"),
]
ROBOT_PATHS = ["/", "", "/private", "/private/open/1", "/private/x", "/a.pdf", "/a.pdf?x", "/x1y", "/x/z", "/early"]
FEED = json.dumps({"products": [
    {"id": 1, "title": " Mat ", "handle": "mat", "vendor": "V", "product_type": "Mats", "body_html": "<p>Soft</p>", "images": [{"src": "i.png"}], "variants": [
        {"id": 11, "title": "Red", "sku": "M-R", "price": "259000.00", "compare_at_price": "329000.00", "available": True}, {"id": 12, "title": "Blue", "sku": "M-B", "price": "500.00", "compare_at_price": None, "available": False}]},
    {"id": 2, "title": "Rug", "handle": "rug", "vendor": "", "product_type": None, "variants": [{"id": 21, "title": "Default Title", "sku": None, "price": "Liên hệ"}]},
    {"handle": "bare", "title": "Bare", "variants": []},
]})
WOO = json.dumps([
    {"id": 5, "name": "Mat &amp; rug", "permalink": "https://w.example/product/mat", "sku": "W5", "prices": {"price": "35000000", "regular_price": "42000000", "currency_code": "VND", "currency_minor_unit": 2}, "is_in_stock": True, "stock_quantity": 3, "average_rating": "4.50", "review_count": 2, "categories": [{"name": "A"}, {"name": " B "}], "images": [{"src": "w.png"}], "short_description": "<b>x</b>"},
    {"id": 6, "name": "Range", "permalink": "https://w.example/product/r", "prices": {"price": "100", "regular_price": "100", "currency_code": "USD", "currency_minor_unit": 2, "price_range": {"min_amount": "100", "max_amount": "200"}}, "average_rating": "0", "review_count": 0},
    {"id": 7, "name": "Same", "permalink": "https://w.example/product/s", "prices": {"price": "1000", "regular_price": "1000", "currency_code": "USD", "currency_minor_unit": 2}, "is_in_stock": False},
])
LD_PAGE = '<html><script type="application/ld+json">' + json.dumps({"@graph": [{"@type": "WebPage"}, {"@type": ["Product", "Thing"], "@id": "p1", "name": "Mat", "sku": "M1", "brand": {"name": "V"}, "image": ["a.png"], "url": "/products/mat", "aggregateRating": {"ratingValue": "4.8", "reviewCount": 137}, "offers": [{"@type": "Offer", "price": "459000", "priceCurrency": "VND", "availability": "https://schema.org/InStock"}, {"@type": "AggregateOffer", "lowPrice": 1, "highPrice": 2, "priceCurrency": "VND"}]}]}) + "</script><script type='application/ld+json'>{broken</script></html>"
OG_PAGE = '<meta property="og:title" content="Og mat"><meta property="product:price:amount" content="189.000"><meta property="product:price:currency" content="VND"><link rel="canonical" href="/products/og"><meta property="og:image" content="o.png">'
MICRO_PAGE = '<div itemscope><h1 itemprop="name">Micro mat</h1><span itemprop="price" content="329000">329.000</span><meta itemprop="priceCurrency" content="VND"><link itemprop="availability" href="https://schema.org/OutOfStock"><span itemprop="sku">MM-1</span></div>'
GUESS_PAGE = '<a href="/products/a">Mat A</a> <span>1.250.000₫</span><a href="/products/b">Mat B</a><b>250.000 đ</b><a href="/products/c">Mat C</a> Liên hệ<a href="https://o.example/z">Away</a> 99.000₫'
PAGES = [("s1", "https://x.example/products/mat", LD_PAGE), ("s2", "https://x.example/products/og", OG_PAGE), ("s3", "https://x.example/products/micro", MICRO_PAGE), ("s4", "https://x.example/", GUESS_PAGE)]
BODIES = ['\ufeff{"a": 1}', '{"a": "x"}', "{broken", "", "[1, 2]", None]
REDIRECTS = [("a", "b"), ("b", "c"), *[(f"r{i}", f"r{i + 1}" if i < 6 else "end") for i in range(7)], ("self", "self")]
AGENTS = ["ShelfmarkBot/1.0 (+https://a.example)", " Other ", "A/b/c", ""]
ROBOT_ANSWERS = [("https://a.example", 200, ROBOTS[0][1]), ("https://gone.example", 404, "User-agent: *\nDisallow: /"), ("https://down.example", 503, ""), ("https://mute.example", None, None)]
ROBOT_QUESTIONS = [("https://a.example", "/private"), ("https://a.example", "/open"), ("https://gone.example", "/private"), ("https://down.example", "/open"), ("https://mute.example", "/open"), ("https://never.example", "/open")]
GROUPS = [
    ("https://long.example", "User-agent: shelf\nDisallow: /y\n\nUser-agent: shelfmark\nDisallow: /x\n"), ("https://short.example", "User-agent: shelfmark\nDisallow: /x\n\nUser-agent: shelf\nDisallow: /y\n"),
    ("https://star.example", "User-agent: marker\nDisallow: /y\n\nUser-agent: *\nDisallow: /\n"),
]
FETCHES = [
    ("s", "u1", 503, ""), ("s", "u1", 200, "ok"), ("s", "u1", 404, ""), ("s", "u2", 429, ""), ("s", "u2", None, None), ("s", "u2", 503, ""), ("s", "u2", 200, "too late"), ("s", "u3", 404, ""),
    ("s", "u4", 403, ""), ("s", "u5", 200, "<title>Just a moment...</title>"), ("s", "u6", 500, ""), ("s", "u7", None, None), ("t", "u1", 408, ""),
]
STATES = [
    (200, "<title>Just a moment...</title><p>" + "words " * 200), (403, '<link href="https://cdn.shopify.com/x.css"><p>' + "words " * 200), (200, '<img src="/wp-content/a.png"><p>' + "words " * 200), (200, '<div id="app"></div><script>' + "x" * 50 + "</script>"),
    (200, "<p>" + "words " * 200), (200, "<script src=\"//theme.hstatic.net/a.js\"></script><p>Giá 1.250.000₫</p>"), (200, "  "), (200, "<script>var c='captcha-delivery'</script><p>" + "words " * 200),
]
SCALARS = ["  a b ", "", "  ", "0", None]
DAYS = [("2026-09-01", "2026-09-02"), ("2026-09-01 12:00:00", "2026-09-01"), ("no day", "2026-09-01"), (None, "2026-09-01"), ("2026-10-02", "2026-09-01"), ("2026-09-01T06:00:00", "2026-09-01T12:00:00")]
SITEMAP_PAGES = [
    ("s1", 0, "https://a.example/sitemap.xml", "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.example/{x}</loc></sitemap>" for x in ("pages.xml", "product-1.xml", "posts.xml", "san-pham-2.xml", "product-1.xml")) + "</sitemapindex>"),
    ("s1", 1, "https://a.example/product-1.xml", "<urlset>" + "".join(f"<url><loc>https://a.example/{x}</loc></url>" for x in ("about", "products/a", "products/b", "products/a")) + "</urlset>"),
    ("s2", 0, "https://b.example/products.xml", "<urlset><url><loc>https://b.example/one</loc></url><url><loc>https://b.example/two</loc></url></urlset>"),
]
RAGGED = [["a"], ["b", "c", "d"], [], ["e", "f"]]
REQUESTS = [
    ("g1", "https://x.example/products/mat", None), ("g2", "https://shopee.vn/brand", None), ("g3", "https://x.example/go", "https://shopee.vn/brand"), ("g4", "https://x.example/collections/mats", None), ("g5", "not an address", None), ("g6", "https://x.example/shell", None),
]
GATED_PAGES = [
    ("g1", "https://x.example/products/mat", LD_PAGE, "entered"), ("g1", "https://x.example/products/micro", MICRO_PAGE, "product"), ("g2", "https://shopee.vn/brand", GUESS_PAGE, "entered"), ("g3", "https://shopee.vn/brand", GUESS_PAGE, "entered"),
    ("g4", "https://x.example/products.json", FEED, "feed"), ("g4", "https://x.example/collections/mats", GUESS_PAGE, "entered"), ("g6", "https://x.example/shell", '<div id="root"></div>', "entered"),
]
NAMES = ["em", "đệm", "dừa", None, "zeta", "an", "đệm"]
CELLS = ["=1+1", "+1", "-1", "@x", "plain", "", "'=ok", "a,b", 'say "hi"', "x;y", "two\nlines"]
SITEMAPS = ["<sitemapindex><sitemap><loc> https://a.example/s1.xml </loc></sitemap></sitemapindex>", "<urlset><url><loc>https://a.example/?a=1&amp;b=2</loc></url><url><LOC>\n</LOC></url></urlset>"]
