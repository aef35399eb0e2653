"""The schemas of the tables; every field of the raw records is optional."""

RAW_POSTS = "id string, subreddit string, title string, selftext string, author string, author_flair_text string, link_flair_text string, score long, created_utc long, num_comments long, over_18 boolean, url string"
RAW_COMMENTS = "id string, link_id string, parent_id string, author string, author_flair_text string, score long, created_utc long, body string"
RAW = {"posts": RAW_POSTS, "comments": RAW_COMMENTS}
CHUNKS = "sub string, kind string, file string, start long, end long, est long, rows long, finished_at long"
POSTS = "pid long, id string, sub string, title string, selftext string, author string, flair string, link_flair string, score long, created long, num_comments long, url string"
COMMENTS = "cid long, id string, post_id string, parent string, author string, flair string, score long, created long, body string"
FIELDS = {kind: [f.split()[0] for f in schema.split(", ")] for kind, schema in RAW.items()}
