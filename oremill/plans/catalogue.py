"""The queries of the core operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.functions.ids import valid_id
from oremill.functions.shared import written
from oremill.operators import cf, content, explore, graph, itemsets, multivalue, similarity
from oremill.plans import oracle
from oremill.sources import readers, sinks

YEAR, TOP, BUSY, PARTS, THRESHOLD = 2014, 20, 50, 8, 3

# Exploration ----------------------------------------------------------------------------------------------------------


def review_total(spark: SparkSession, folder: str) -> DataFrame:
    return explore.review_total(readers.reviews(spark, folder))


def reviews_in_year(spark: SparkSession, folder: str) -> DataFrame:
    return explore.reviews_in_year(readers.reviews(spark, folder), YEAR)


def distinct_users(spark: SparkSession, folder: str) -> DataFrame:
    return explore.distinct_users(readers.reviews(spark, folder))


def top_users(spark: SparkSession, folder: str) -> DataFrame:
    return explore.top_users(readers.reviews(spark, folder), TOP)


def _stopwords(spark: SparkSession, folder: str) -> DataFrame:
    return readers.clean_stopwords(readers.table(spark, folder, "stopwords"))


def top_words(spark: SparkSession, folder: str) -> DataFrame:
    return explore.top_words(readers.reviews(spark, folder), _stopwords(spark, folder), TOP)


def top_words_not_empty(spark: SparkSession, folder: str) -> DataFrame:
    return explore.top_words(readers.reviews(spark, folder), _stopwords(spark, folder), TOP, keep_empty=False)


def exploration_report(spark: SparkSession, folder: str) -> DataFrame:
    """The five questions in one JSON document."""
    reviews = readers.reviews(spark, folder)
    parts = {"A": explore.review_total(reviews), "B": explore.reviews_in_year(reviews, YEAR), "C": explore.distinct_users(reviews), "D": explore.top_users(reviews, TOP)}
    parts["E"] = explore.top_words(reviews, _stopwords(spark, folder), TOP).select("word")
    return sinks.json_document(parts)


def category_avg_stars(spark: SparkSession, folder: str) -> DataFrame:
    rated = readers.reviews(spark, folder).where("stars between 1 and 5 and not isnan(stars)")
    return explore.category_average(rated, readers.businesses(spark, folder))


def partition_sizes_default(spark: SparkSession, folder: str) -> DataFrame:
    return explore.partition_profile(readers.reviews(spark, folder))


def partition_sizes_custom(spark: SparkSession, folder: str) -> DataFrame:
    return explore.partition_profile(readers.reviews(spark, folder).where("business_id is not null"), PARTS, "business_id")


def partition_report(spark: SparkSession, folder: str) -> DataFrame:
    """Number and sizes of the custom partitions and the businesses with many reviews, in one JSON document."""
    sizes = partition_sizes_custom(spark, folder)
    parts = {"n_partitions": sizes.agg(F.count("*").alias("total")), "n_items": sizes.select("rows", F.col("partition").alias("_partition")), "result": businesses_over_n(spark, folder)}
    return sinks.json_document(parts, {"n_items": [F.col("_partition")], "result": [F.col("business_id")]})


def category_report(spark: SparkSession, folder: str) -> DataFrame:
    """The categories with the best average, in one JSON document."""
    best = category_avg_stars(spark, folder).limit(TOP)
    return sinks.json_document({"result": best}, {"result": [-F.col("avg_stars"), F.col("category")]})


def businesses_over_n(spark: SparkSession, folder: str) -> DataFrame:
    return explore.busy_businesses(readers.reviews(spark, folder), BUSY)


def state_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return explore.state_pairs(readers.reviews(spark, folder).where("user_id is not null"), readers.businesses(spark, folder), "NV")


# Frequent itemsets ----------------------------------------------------------------------------------------------------


def baskets_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return itemsets.basket_lists(itemsets.baskets(readers.state_extract(spark, folder), "user_id", "business_id"))


def baskets_by_item(spark: SparkSession, folder: str) -> DataFrame:
    return itemsets.basket_lists(itemsets.baskets(readers.state_extract(spark, folder), "business_id", "user_id"))


def baskets_min_size(spark: SparkSession, folder: str) -> DataFrame:
    return itemsets.basket_lists(itemsets.baskets(readers.state_extract(spark, folder), "user_id", "business_id", 3))


def _event_baskets(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Event types by user and day, and a support of a twentieth of the baskets."""
    rows = itemsets.baskets(readers.event_baskets(spark, folder), "basket", "item")
    number = rows.agg(F.count_distinct("basket")).first()[0]
    return rows, max(1, -(-number // 20))


def _sets(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("itemset", ",").alias("itemset"), F.col("size").cast("bigint").alias("size"), "support")


def frequent_singles(spark: SparkSession, folder: str) -> DataFrame:
    rows, support = _event_baskets(spark, folder)
    return _sets(itemsets.frequent_itemsets(rows, support, most_size=1))


def frequent_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows, support = _event_baskets(spark, folder)
    return _sets(itemsets.frequent_itemsets(rows, support, most_size=2).where("size = 2"))


def frequent_triples(spark: SparkSession, folder: str) -> DataFrame:
    rows, support = _event_baskets(spark, folder)
    return _sets(itemsets.frequent_itemsets(rows, support, most_size=3).where("size = 3"))


def _candidates(rows: DataFrame, support: int) -> DataFrame:
    return itemsets.son_candidates(rows, support, 4, F.pmod("basket", F.lit(4)))


def son_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows, support = _event_baskets(spark, folder)
    return _candidates(rows, support).select(F.array_join("itemset", ",").alias("itemset"), F.col("size").cast("bigint").alias("size"))


def frequent_all(spark: SparkSession, folder: str) -> DataFrame:
    """Both passes of SON."""
    rows, support = _event_baskets(spark, folder)
    return _sets(itemsets.frequent_itemsets(rows, support, _candidates(rows, support)))


def frequent_businesses(spark: SparkSession, folder: str) -> DataFrame:
    """Sets of businesses that the same 10 or more users reviewed."""
    rows = itemsets.baskets(readers.reviews(spark, folder), "user_id", "business_id")
    return _sets(itemsets.frequent_itemsets(rows, 10))


def frequent_state_businesses(spark: SparkSession, folder: str) -> DataFrame:
    """Sets of businesses that the same 10 or more users of the state extract have, by both passes of SON."""
    rows = written(itemsets.baskets(readers.state_extract(spark, folder), "user_id", "business_id"), "baskets")
    found = itemsets.son_candidates(rows, 10, 4, F.pmod(F.xxhash64("basket"), F.lit(4)))
    return _sets(itemsets.frequent_itemsets(rows, 10, found))


def itemset_report(spark: SparkSession, folder: str) -> DataFrame:
    rows, support = _event_baskets(spark, folder)
    found = _candidates(rows, support)
    return sinks.itemset_report(found, itemsets.frequent_itemsets(rows, support, found))


# Similarity -----------------------------------------------------------------------------------------------------------


def _user_sets(spark: SparkSession, folder: str) -> DataFrame:
    return readers.ratings(spark, folder).select("business_id", "user_id")


def minhash_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.minhash_signatures(_user_sets(spark, folder), start_hash=1)


def lsh_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.lsh_pairs(similarity.minhash_signatures(_user_sets(spark, folder), start_hash=1))


def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.jaccard_pairs(_user_sets(spark, folder))


def user_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.seeded_signatures(_user_sets(spark, folder))


# Content --------------------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews for profiles, which take each (business, user, text) once: a redelivery is one of its repeats, and needs no shuffle of its own."""
    return readers.reviews(spark, folder, once=False)


def word_document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return content.document_frequency(content.document_words(_texts(spark, folder), _stopwords(spark, folder)))


def business_profile(spark: SparkSession, folder: str) -> DataFrame:
    return content.tfidf_profile(_texts(spark, folder), _stopwords(spark, folder))


def tfidf_top(spark: SparkSession, folder: str) -> DataFrame:
    return content.tfidf_profile(_texts(spark, folder), _stopwords(spark, folder), 10)


def user_profile(spark: SparkSession, folder: str) -> DataFrame:
    profile = written(content.tfidf_profile(_texts(spark, folder), _stopwords(spark, folder)), "profile")
    return content.user_profile(_texts(spark, folder), profile)


def content_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of the profiles of all users and the businesses they reviewed."""
    reviews = _texts(spark, folder)
    profile = written(content.tfidf_profile(reviews, _stopwords(spark, folder)), "profile")
    pairs = readers.reviews(spark, folder).select("user_id", "business_id").where("user_id is not null and business_id is not null")
    return content.content_scores(pairs, content.user_profile(reviews, profile), profile)


# Collaborative filtering ----------------------------------------------------------------------------------------------


def item_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return cf.item_similarity(readers.ratings(spark, folder))


def user_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return cf.user_similarity(readers.ratings(spark, folder))


def user_lsh_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cf.user_lsh_pairs(readers.ratings(spark, folder))


def user_similarity_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return cf.user_similarity(readers.ratings(spark, folder), mode="minhash")


def predict_item_based(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings of all rated pairs, predicted from the user's other ratings by the pair model."""
    ratings = readers.ratings(spark, folder)
    return cf.predict_item_based(ratings, ratings, readers.item_model(spark, folder).where("sim > 0"))


def predict_user_based(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings of all rated pairs, predicted from similar users."""
    ratings = readers.ratings(spark, folder)
    return cf.predict_user_based(ratings, ratings, cf.user_similarity(ratings))


# Graphs ---------------------------------------------------------------------------------------------------------------


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return graph.co_review_graph(readers.state_extract(spark, folder), THRESHOLD)


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder)[0]


def graph_vertices(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder)[1]


def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(_graph(spark, folder)[0])


def label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return graph.label_propagation(_graph(spark, folder)[0])


def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    edges, vertices = _graph(spark, folder)
    return graph.connected_components(vertices, edges)


def edge_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edge_betweenness(_graph(spark, folder)[0]).withColumn("value", F.round("value", 6))


def edge_removal_first_round(spark: SparkSession, folder: str) -> DataFrame:
    edges, _ = _graph(spark, folder)
    return graph.remove_top_edges(edges, graph.edge_betweenness(edges))


def modularity_of_components(spark: SparkSession, folder: str) -> DataFrame:
    edges, vertices = _graph(spark, folder)
    return graph.modularity(graph.connected_components(vertices, edges), edges).select(F.round("value", 6).alias("value"))


def girvan_newman(spark: SparkSession, folder: str) -> DataFrame:
    return graph.girvan_newman(_graph(spark, folder)[0])


def gn_dendrogram(spark: SparkSession, folder: str) -> DataFrame:
    return graph.gn_dendrogram(_graph(spark, folder)[0])


def gn_dendrogram_members(spark: SparkSession, folder: str) -> DataFrame:
    return graph.dendrogram_members(_graph(spark, folder)[0])


def label_community_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.community_lines(graph.community_listing(label_propagation(spark, folder)))


def community_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.community_lines(graph.community_listing(graph.girvan_newman(_graph(spark, folder)[0])))


def betweenness_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.betweenness_lines(edge_betweenness(spark, folder))


# Several values in one field ------------------------------------------------------------------------------------------


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every category name of every business, with its position."""
    rows = readers.table(spark, folder, "business").select(valid_id("business_id").alias("business_id"), "categories")
    fields = rows.where("business_id is not null").groupBy("business_id").agg(F.max("categories").alias("categories"))
    names = multivalue.known_names(readers.table(spark, folder, "category_ref"), "category_name")
    return multivalue.split_values(fields, "categories", names, value="category", position="pos")


_QUERIES = (
    review_total, reviews_in_year, distinct_users, top_users, top_words, top_words_not_empty, exploration_report, category_avg_stars, partition_sizes_default,
    partition_sizes_custom, partition_report, category_report, businesses_over_n, state_pairs, baskets_by_user, baskets_by_item, baskets_min_size, frequent_singles, frequent_pairs,
    frequent_triples, frequent_all, frequent_businesses, frequent_state_businesses, son_candidates, itemset_report, minhash_signatures, lsh_pairs, jaccard_pairs, user_signatures,
    word_document_frequency, business_profile, tfidf_top, user_profile, content_scores, item_similarity, user_similarity, user_lsh_pairs, user_similarity_minhash,
    predict_item_based, predict_user_based, graph_edges, graph_vertices, graph_degrees, label_propagation, connected_components, edge_betweenness,
    edge_removal_first_round, modularity_of_components, girvan_newman, gn_dendrogram, gn_dendrogram_members, label_community_report, community_report, betweenness_report, p2_found,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
