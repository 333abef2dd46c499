"""Fixed values of the evaluation surface: instructions by task name and type, benchmark names.

Stated as they must be for equal results; nothing here is computed but the benchmarks' aliases.
"""

from __future__ import annotations

import re

#: Instruction of a task type, where the task has none of its own.
BY_TYPE = {
    "Classification": "Categorizing the given news title",
    "Clustering": "Categorizing the given news title",
    "Retrieval": "Given a query, retrieve documents that answer the query",
    "Reranking": "Given a query, retrieve documents that answer the query",
    "STS": "Retrieve semantically similar text",
    "PairClassification": "Retrieve semantically similar text",
    "BitextMining": "Given two sentences, judge whether they are translations of each other",
    "MultilabelClassification": "Given a text, classify it into one or more categories",
    "Regression": "Given a text, predict its score",
    "InstructionRetrieval": "Given a query, retrieve documents that answer the query",
    "Summarization": "Retrieve semantically similar summaries",
    "Speed": "Given a text, encode it into a fixed-size vector representation",
}

#: Fixed values: (task type, task name without version) -> instruction.
BY_TASK = {
    ("Classification", "AmazonCounterfactualClassification"): "Given an Amazon review, judge whether it is counterfactual.",
    ("Classification", "AmazonPolarityClassification"): "Classifying Amazon reviews into positive or negative sentiment",
    ("Classification", "AmazonReviewsClassification"): "Classifying the given Amazon review into its appropriate rating category",
    ("Classification", "Banking77Classification"): "Given a online banking query, find the corresponding intents",
    ("Classification", "EmotionClassification"): "Classifying the emotion expressed in the given Twitter message into one of the six emotions: anger, fear, joy, love, sadness, and surprise",
    ("Classification", "ImdbClassification"): "Classifying the sentiment expressed in the given movie review text from the IMDB dataset",
    ("Classification", "MassiveIntentClassification"): "Given a user utterance as query, find the user intents",
    ("Classification", "MassiveScenarioClassification"): "Given a user utterance as query, find the user scenarios",
    ("Classification", "MTOPDomainClassification"): "Classifying the intent domain of the given utterance in task-oriented conversation",
    ("Classification", "MTOPIntentClassification"): "Classifying the intent of the given utterance in task-oriented conversation",
    ("Classification", "ToxicConversationsClassification"): "Classifying the given comments as either toxic or not toxic",
    ("Classification", "TweetSentimentExtractionClassification"): "Classifying the sentiment of a given tweet as either positive, negative, or neutral",
    ("Classification", "TNews"): "Categorizing the given news title",
    ("Classification", "IFlyTek"): "Given an App description text, find the appropriate fine-grained category",
    ("Classification", "MultilingualSentiment"): "Classifying sentiment of the customer review into positive, neutral, or negative",
    ("Classification", "JDReview"): "Classifying sentiment of the customer review for iPhone into positive or negative",
    ("Classification", "OnlineShopping"): "Classifying sentiment of the customer review into positive or negative",
    ("Classification", "Waimai"): "Classify the customer review from a food takeaway platform into positive or negative",
    ("Clustering", "ArxivClusteringP2P"): "Identify the main and secondary category of Arxiv papers based on the titles and abstracts",
    ("Clustering", "ArxivClusteringS2S"): "Identify the main and secondary category of Arxiv papers based on the titles",
    ("Clustering", "BiorxivClusteringP2P"): "Identify the main category of Biorxiv papers based on the titles and abstracts",
    ("Clustering", "BiorxivClusteringS2S"): "Identify the main category of Biorxiv papers based on the titles",
    ("Clustering", "MedrxivClusteringP2P"): "Identify the main category of Medrxiv papers based on the titles and abstracts",
    ("Clustering", "MedrxivClusteringS2S"): "Identify the main category of Medrxiv papers based on the titles",
    ("Clustering", "RedditClustering"): "Identify the topic or theme of Reddit posts based on the titles",
    ("Clustering", "RedditClusteringP2P"): "Identify the topic or theme of Reddit posts based on the titles and posts",
    ("Clustering", "StackExchangeClustering"): "Identify the topic or theme of StackExchange posts based on the titles",
    ("Clustering", "StackExchangeClusteringP2P"): "Identify the topic or theme of StackExchange posts based on the given paragraphs",
    ("Clustering", "TwentyNewsgroupsClustering"): "Identify the topic or theme of the given news articles",
    ("Clustering", "CLSClusteringS2S"): "Identify the main category of scholar papers based on the titles",
    ("Clustering", "CLSClusteringP2P"): "Identify the main category of scholar papers based on the titles and abstracts",
    ("Clustering", "ThuNewsClusteringS2S"): "Identify the topic or theme of the given news articles based on the titles",
    ("Clustering", "ThuNewsClusteringP2P"): "Identify the topic or theme of the given news articles based on the titles and contents",
    ("PairClassification", "SprintDuplicateQuestions"): "Retrieve semantically similar questions",
    ("Reranking", "AskUbuntuDupQuestions"): "Retrieve semantically similar questions",
    ("Reranking", "StackOverflowDupQuestions"): "Retrieve semantically similar questions",
    ("Reranking", "SciDocsRR"): "Retrieve relevant paper titles",
    ("Retrieval", "QuoraRetrieval"): "Retrieve semantically similar questions",
    ("Retrieval", "CQADupstack"): "Given a question, retrieve detailed question descriptions from Stackexchange that are duplicates to the given question",
    ("Summarization", "SummEval"): "Retrieve semantically similar summaries",
}

#: Public benchmark names.
BENCHMARKS = (
    "BEIR", "BEIR-NL", "BRIGHT", "BRIGHT (long)", "BuiltBench(eng)", "ChemTEB", "CoIR", "CodeRAG", "Encodechka", "FollowIR", "JinaVDR", "LongEmbed",
    "MIEB(Img)", "MIEB(Multilingual)", "MIEB(eng)", "MIEB(lite)", "MINERSBitextMining", "MTEB(Code, v1)", "MTEB(Europe, v1)", "MTEB(Indic, v1)",
    "MTEB(Law, v1)", "MTEB(Medical, v1)", "MTEB(Multilingual, v1)", "MTEB(Multilingual, v2)", "MTEB(Scandinavian, v1)", "MTEB(cmn, v1)", "MTEB(deu, v1)",
    "MTEB(eng, v1)", "MTEB(eng, v2)", "MTEB(fas, v1)", "MTEB(fra, v1)", "MTEB(jpn, v1)", "MTEB(kor, v1)", "MTEB(pol, v1)", "MTEB(rus, v1)", "NanoBEIR",
    "R2MED", "RAR-b", "RuSciBench", "VN-MTEB (vie, v1)", "ViDoRe(v1)", "ViDoRe(v2)", "VisualDocumentRetrieval",
)


def alias(name: str) -> str:
    """A benchmark's name on a command line: capitals, one underscore for whatever is no letter or digit."""
    return re.sub(r"[^A-Z0-9]+", "_", name.upper()).strip("_")


def benchmark(text: str) -> str:
    """The benchmark of an alias or a name; another one raises."""
    found = {alias(b): b for b in BENCHMARKS}.get(alias(text))
    if found is None:
        raise ValueError(f"unknown benchmark {text}")
    return found
