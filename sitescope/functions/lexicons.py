"""Fixed values.

These word lists, theme dictionaries and label maps must equal the analysed
application's values for results to agree. They are stated plainly, in their
natural order, and every operator takes them as overridable parameters.
"""

# ---------------------------------------------------------------------------
# Stopwords removed by the keyword tokenizer (124 words)
# ---------------------------------------------------------------------------
STOPWORDS = (
    'the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for',
    'of', 'with', 'by', 'from', 'up', 'about', 'into', 'through', 'was',
    'were', 'been', 'be', 'have', 'has', 'had', 'do', 'does', 'did',
    'will', 'would', 'could', 'should', 'may', 'might', 'must', 'can',
    'is', 'am', 'are', 'this', 'that', 'these', 'those', 'i', 'you',
    'he', 'she', 'it', 'we', 'they', 'what', 'which', 'who', 'when',
    'where', 'why', 'how', 'all', 'each', 'every', 'both', 'few', 'more',
    'most', 'other', 'some', 'such', 'no', 'nor', 'not', 'only', 'own',
    'same', 'so', 'than', 'too', 'very', 's', 't', 'just', 'don', 'now',
    'also', 'as', 'if', 'there', 'their', 'them', 'then', 'get', 'make',
    'go', 'see', 'know', 'take', 'think', 'come', 'give', 'use', 'find',
    'tell', 'ask', 'work', 'seem', 'feel', 'try', 'leave', 'call', 'way',
    'like', 'back', 'look', 'thing', 'much', 'any', 'well', 'said', 'one',
    'two', 'three', 'lot', 'bit', 're',
)

# ---------------------------------------------------------------------------
# Sentiment lexicon (26 positive, 14 negative words)
# ---------------------------------------------------------------------------
POSITIVE_WORDS = (
    'good', 'great', 'excellent', 'amazing', 'helpful', 'useful', 'interesting',
    'engaging', 'informative', 'educational', 'important', 'valuable', 'enjoyable',
    'loved', 'liked', 'wonderful', 'fantastic', 'effective', 'clear', 'powerful',
    'relevant', 'impactful', 'necessary', 'appreciated', 'inspiring', 'eye-opening',
)
NEGATIVE_WORDS = (
    'boring', 'confusing', 'unclear', 'missing', 'lacking', 'insufficient',
    'poor', 'bad', 'wrong', 'difficult', 'hard', 'complicated', 'too', 'very',
)

# Sentiment class boundaries: > 0.2 positive, < -0.2 negative, else neutral.
SENTIMENT_BAND = 0.2

# ---------------------------------------------------------------------------
# Positive-feedback themes (6 themes, substring keywords)
# ---------------------------------------------------------------------------
POSITIVE_THEMES = {
    'Story/Personal': ['story', 'breck', 'personal', 'real', 'life', 'lewis', 'tragic', 'happened'],
    'Grooming': ['grooming', 'groomed', 'groomer', 'manipulation', 'predator', 'warning', 'signs'],
    'Educational': ['learned', 'information', 'knowledge', 'understand', 'aware', 'facts', 'teach'],
    'Safety': ['safety', 'safe', 'protect', 'danger', 'risk', 'careful', 'secure'],
    'Interactive': ['interactive', 'quiz', 'questions', 'discussion', 'activities', 'engaging'],
    'Presenter': ['presenter', 'speaker', 'delivery', 'explained', 'talked', 'presented'],
}

# ---------------------------------------------------------------------------
# Improvement-suggestion themes (7 themes)
# ---------------------------------------------------------------------------
IMPROVEMENT_THEMES = {
    'More time/depth': ['more', 'longer', 'time', 'detail', 'depth', 'expand', 'elaborate'],
    'More interactivity': ['interactive', 'activities', 'games', 'quiz', 'participation', 'hands-on'],
    'Visuals/videos': ['video', 'visual', 'images', 'picture', 'graphic', 'media', 'clips'],
    'More examples': ['example', 'case', 'scenario', 'situation', 'real-life'],
    'Q&A session': ['question', 'answer', 'ask', 'clarify', 'discuss'],
    'Social media': ['social', 'media', 'platform', 'instagram', 'tiktok', 'snapchat'],
    'Statistics/facts': ['statistic', 'data', 'number', 'fact', 'figure', 'research'],
}

# ---------------------------------------------------------------------------
# News safety topics (10 topics)
# ---------------------------------------------------------------------------
SAFETY_TOPICS = {
    'online_grooming': ['grooming', 'predator', 'exploitation', 'child abuse', 'sextortion'],
    'cyberbullying': ['cyberbully', 'harassment', 'trolling', 'online abuse', 'hate'],
    'privacy': ['privacy', 'data protection', 'personal information', 'tracking'],
    'social_media': ['social media', 'instagram', 'tiktok', 'snapchat', 'facebook'],
    'gaming': ['gaming', 'online game', 'minecraft', 'fortnite', 'roblox'],
    'ai_risks': ['ai', 'artificial intelligence', 'deepfake', 'chatbot', 'generative'],
    'misinformation': ['misinformation', 'fake news', 'disinformation', 'conspiracy'],
    'mental_health': ['mental health', 'anxiety', 'depression', 'wellbeing', 'self-harm'],
    'sexting': ['sexting', 'nude', 'explicit', 'image sharing'],
    'identity_theft': ['identity theft', 'fraud', 'scam', 'phishing'],
}

# News recommendation messages keyed by topic (only these two topics have one).
NEWS_TOPIC_MESSAGES = {
    'ai_risks': "Consider adding content about AI risks (deepfakes, AI chatbots) - emerging trend in news",
    'gaming': "Expand gaming safety section - high media coverage of gaming-related risks",
}

# ---------------------------------------------------------------------------
# Survey answer cleaning
# ---------------------------------------------------------------------------
# Age bands, checked in this order: (substrings, label)
AGE_BANDS = (
    (('11 - 13', '11-13'), '11-13'),
    (('14 - 16', '14-16'), '14-16'),
    (('16+',), '16+'),
    (('10 or under',), '10 or under'),
)
# Rating labels, checked in this order (case-sensitive substring)
RATING_LABELS = ('Excellent', 'Good', 'Fair', 'Poor')
RATING_SCORES = {'Excellent': 5, 'Good': 4, 'Fair': 3, 'Poor': 2, 'Very Poor': 1}
# Satisfied ratings for the satisfaction rate
SATISFIED_RATINGS = ('Excellent', 'Good')

# "Nothing" answers in improvement suggestions
NOTHING_PATTERN = 'nothing|no|none|n/a'
NOT_SUBSTANTIVE_PATTERN = '^(nothing|no|none|n/?a)$'

# ---------------------------------------------------------------------------
# Site grouping (inverted group index)
# ---------------------------------------------------------------------------
GROUP_KEY_WORD = 'academy'
ACADEMY_SUFFIXES = ('primary', 'secondary', 'junior', 'infant', 'school')
GROUP_STOPWORDS = ('school', 'primary', 'secondary', 'academy', 'junior', 'infant', 'church')
GROUP_MIN_WORD_LEN = 5  # words longer than 4 characters

# Geocode confidence: address words that make a hit "high" confidence
HIGH_CONFIDENCE_WORDS = ('school', 'academy', 'college', 'education')

# Trust value that never counts as a trust
NO_TRUST_VALUE = 'not applicable'

# Cluster marker palette (index = cluster id mod 10)
CLUSTER_PALETTE = ('red', 'blue', 'green', 'purple', 'orange',
                   'darkred', 'lightred', 'beige', 'darkblue', 'darkgreen')

# ---------------------------------------------------------------------------
# Earth radii (km) and the grid-to-degrees approximation
# ---------------------------------------------------------------------------
GREAT_CIRCLE_RADIUS_KM = 6371.009   # mean radius used by the great-circle distance
HAVERSINE_RADIUS_KM = 6371.0        # radius used by haversine / nearest-neighbour code
GRID_ORIGIN_LAT = 49.0
GRID_ORIGIN_LON = -2.0
GRID_FALSE_EASTING = 400000.0
GRID_FALSE_NORTHING = -100000.0
KM_PER_DEGREE_M = 111000.0
HULL_KM2_PER_DEG2 = 111 * 111
