"""Small hand-made pages."""


def result_row(n, date=" Dec 11", price=" $1450", area=" (HARBOUR)", href=None, title=None, cat="cars"):
    """A result row with the elements that are read, and nothing else."""
    link = href or f"http://porto.en.x.org/bik/{n}.html"
    area_markup = f"<font>{area}</font>" if area is not None else ""
    price_markup = f'<span class="itempp">{price}</span>' if price is not None else ""
    return f"""<p class="row">
      <span class="itemdate">{date}</span>
      <a href="{link}">{title or f"item {n}"}</a>
      {price_markup}
      <span class="itempn">{area_markup}</span>
      <span class="itemcg"><a href="/{n % 7}/">{cat}</a></span>
    </p>"""


def result_page(rows):
    return (
        '<html><body><p>intro</p><a href="/nav">navigation</a><span class="itempp">$0</span>'
        + "".join(rows)
        + "<p>footer</p></body></html>"
    )


def feed(links, quote='"'):
    items = "".join(f"<rdf:li rdf:resource={quote}{link}{quote} />\n" for link in links)
    return (
        '<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="r"><channel rdf:about="x"><title>t</title>'
        f"<items><rdf:Seq>\n{items}</rdf:Seq></items></channel></rdf:RDF>"
    )


def detail_page(title="T", body="some text", time="2012-12-11", images=None):
    script = ""
    if images is not None:
        listed = ",".join(f'"{image}"' for image in images)
        script = f'<script type="text/javascript">imgList = [{listed}];</script>'
    parts = [
        f'<h2 class="postingtitle">{title}</h2>' if title is not None else "",
        f"<time>{time}</time>" if time is not None else "",
        f'<section class="userbody">{body}{script}</section>' if body is not None else "",
    ]
    return "<html><body>" + "".join(parts) + "</body></html>"


def match_page(count, originals=()):
    places = "".join(
        f'<div class="search-results-location"><span title="s"><strong>s</strong></span>'
        f'<p><a href="{url}" title="x">x</a> <a href="http://s/" class="url">s</a></p></div>'
        for url in originals
    )
    return f"<div><h2><span>{count}</span> Results</h2></div>{places}"


# Column names of the register files; fixed values.
REGISTER_HEADER = [
    "Jurisdiction Code", "Report Year", "Occurence Number", "Property Case Status", "Item Status",
    "Manufacturer's name", "Style", "Model", "Color", "Type", "Seed", "Serial number",
    "Plate or Sticker", "Brake Type", "Fender Type", "Frame Size", "Handle Bars",
    "Registration Number", "Wheel size", "Seat style",
]


def register_line(year, number, make, model, color):
    cells = ["VA", year, number, "1", "1", make, "M", model, color, "MT"] + [""] * 10
    return "\t".join(cells)


REGISTER_LINES = [
    register_line("2012", "1", "ORLEN", "NIGHTOWL", "SILRED"),
    register_line("2012", "2", "HALBERD", "", "WHI"),
    register_line("2013", "3", "HALBERD", "", "BLU"),
    register_line("2013", "4", "OTHER", 'RIDGE "LANTERN"', "BGE"),
    register_line("2013", "5", "FJORD", "7.4 DELTA", "BLK"),
]
