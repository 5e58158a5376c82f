"""What public benchmark networks are made of: plain declarations that :mod:`builders` carries out."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Relation:
    """An edge type as the raw files have it, and the name of its inverse."""

    src: str
    name: str
    dst: str
    inverse: str


@dataclass(frozen=True)
class Block:
    """Attribute columns low up to high (not included; none: to the last) of a node type as a node type of their own.

    ``kind``: ``one-hot`` (1 or nothing), ``words`` (counts, weights by row and by
    word), ``numbers`` (signed weights by row and by column), ``with-mean`` (one
    number beside the mean magnitude of all), ``train-year`` (a year, over the range
    of the training rows and for these only).
    """

    of: str
    to: str
    kind: str
    forward: str
    backward: str
    low: int = 0
    high: int | None = None


@dataclass(frozen=True)
class Spec:
    """``layout`` is ``pairs`` (an edge type is all links between two node types), ``numbered`` (one relation number each) or ``folders`` (one file each).

    ``labels``: ``multi`` (arrays of 0 and 1), ``single`` (the smallest class; null if
    none) or ``single-or-minus-one``.
    """

    ntypes: tuple[str, ...]
    relations: tuple[Relation, ...]
    layout: str = "pairs"
    target: str | None = None
    labels: str = "single"
    blocks: tuple[Block, ...] = ()
    held: tuple[str, ...] = ()
    symmetric: tuple[str, ...] = ()
    moved_to_train: bool = False


def _between(names: str, inverse: str = "-inv") -> tuple[Relation, ...]:
    """Relations whose names begin with their source and end with their destination."""
    parts = ((n, n.split("-")[0], n.split("-")[-1]) for n in names.split())
    return tuple(Relation(a, n, b, n + inverse) for n, a, b in parts)


def _pairs(pairs: str) -> tuple[Relation, ...]:
    """Relations called after both ends; their inverses too, or with -inv between nodes of one type."""
    ends = (p.split("-") for p in pairs.split())
    return tuple(Relation(a, f"{a}-{b}", b, f"{b}-{a}" if a != b else f"{a}-{b}-inv") for a, b in ends)


# Node types in the order of the files' numbers, and names of edge types, attributes' columns and selections.

IMDB = Spec(
    ("movie", "director", "actor", "keyword"),
    (Relation("movie", "directed-by", "director", "directed"), Relation("movie", "stars", "actor", "acts"), Relation("movie", "contains", "keyword", "is-in")),
    target="movie",
    labels="multi",
)

IMDB_BLOCKS = (
    Block("movie", "numerical", "numbers", "has-numerical", "is-numerical-of", 0, 16),
    Block("movie", "color", "one-hot", "has-color", "is-type-of", 16, 19),
    Block("movie", "language", "one-hot", "is-in-language", "is-language-of", 19, 67),
    Block("movie", "country", "one-hot", "is-from-country", "is-country-of", 67, 132),
    Block("movie", "content_rating", "one-hot", "has-rating", "is-rating-for", 132, 148),
    Block("movie", "word", "words", "contains-word", "is-word-of", 148),
)

DBLP = Spec(
    ("author", "paper", "conference", "term"),
    (Relation("paper", "written-by", "author", "writing"), Relation("paper", "pubs-in", "conference", "has"), Relation("paper", "contains", "term", "is-in")),
    target="author",
)

DBLP_BLOCKS = (
    Block("term", "numerical", "numbers", "has-numerical", "is-numerical-of"),
    Block("paper", "paperfeat", "words", "has-paperfeat", "is-paperfeat-of"),
    Block("author", "authorfeat", "one-hot", "has-authorfeat", "is-authorfeat-of"),
)

#: Names that info.dat may give a node type, and what it is called here.
RENAMED = {"venue": "conference"}

ACM = Spec(
    ("paper", "author", "subject", "term"),
    (Relation("paper", "written-by", "author", "writing"), Relation("paper", "citing", "paper", "cited"), Relation("paper", "is-about", "subject", "has"), Relation("paper", "contains", "term", "is-in")),
    target="paper",
)

FREEBASE = Spec(
    ("book", "film", "music", "sports", "people", "location", "organization", "business"),
    _between(
        """book-and-book book-to-film book-on-sports book-on-location book-about-organization film-and-film music-in-book music-in-film music-and-music
        music-for-sports music-on-location sports-in-film sports-and-sports sports-on-location people-to-book people-to-film people-to-music people-to-sports
        people-and-people people-on-location people-in-organization people-in-business location-in-film location-and-location organization-in-film
        organization-to-music organization-to-sports organization-on-location organization-and-organization organization-for-business business-about-book
        business-about-film business-about-music business-about-sports business-on-location business-and-business"""
    ),
    target="book",
    labels="single-or-minus-one",
)

MAG = Spec(
    ("author", "field_of_study", "institution", "paper"),
    (
        Relation("author", "affiliated_with", "institution", "affiliates"),
        Relation("paper", "cites", "paper", "cited"),
        Relation("author", "writes", "paper", "written_by"),
        Relation("paper", "has_topic", "field_of_study", "contains"),
    ),
    layout="folders",
    target="paper",
)

MAG_BLOCKS = (Block("paper", "year", "train-year", "published-in-year", "year-of-publication"), Block("paper", "numerical", "numbers", "has-numerical", "is-numerical-of"))

AMAZON = Spec(
    ("product",),
    (Relation("product", "co-view", "product", "co-view-inv"), Relation("product", "co-purchase", "product", "co-purchase-inv")),
    layout="numbered",
    held=("co-view", "co-purchase"),
)

AMAZON_BLOCKS = (
    Block("product", "price", "with-mean", "product-price", "price-product", 0, 1),
    Block("product", "sales_rank", "one-hot", "product-sales_rank", "sales_rank-product", 1, 811),
    Block("product", "brand", "one-hot", "product-brand", "brand-product", 811, 814),
    Block("product", "category", "one-hot", "product-category", "category-product", 814),
)

LASTFM = Spec(("user", "artist", "tag"), _pairs("user-artist user-user artist-tag"), layout="numbered", held=("user-artist",), symmetric=("user-user",), moved_to_train=True)

PUBMED_TYPES = ("species", "disease", "chemical", "gene")

PUBMED = Spec(
    PUBMED_TYPES,
    _pairs("species-species species-disease disease-disease chemical-species chemical-disease chemical-chemical chemical-gene gene-species gene-disease gene-gene"),
    layout="numbered",
    held=("disease-disease",),
)

PUBMED_BLOCKS = tuple(Block(n, f"{n}_feat", "numbers", f"{n}-has-feat", f"feat-of-{n}") for n in PUBMED_TYPES)

#: Switches of the refined profile of each network; on gives a node type features, off drops an edge type and its inverse.
REFINED = {
    "atomic-imdb": {"on": "director language country content_rating numerical word", "off": "has-color is-from-country is-in-language"},
    "atomic-freebase": {
        "on": "book business music organization sports",
        "off": """book-to-film business-on-location music-in-book music-in-film organization-and-organization organization-for-business organization-in-film
        organization-to-sports people-in-business people-in-organization people-to-music people-to-sports""",
    },
    "atomic-dblp": {"on": "conference paperfeat", "off": "has-authorfeat has-numerical"},
    "atomic-acm": {"on": "term", "off": ""},
    "atomic-mag": {"on": "field_of_study numerical year", "off": "published-in-year"},
    "atomic-lastfm": {"on": "tag", "off": "user-artist user-user"},
    "atomic-amazon": {"on": "product", "off": "product-brand product-category"},
    "atomic-pubmed": {
        "on": "species disease chemical gene disease_feat",
        "off": "species-species species-disease disease-disease chemical-species chemical-disease gene-gene species-has-feat gene-has-feat",
    },
}
