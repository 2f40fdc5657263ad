import pytest
from pyspark.sql import functions as F

from tomewright.functions import text as X


def one(spark, how, value):
    return spark.createDataFrame([(value,)], "t string").select(how(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("how", "given", "want"),
    [
        (X.unify_line_ends, "a\r\nb\rc", "a\nb\nc"),
        (X.drop_image_marks, "x ==> pic\n2 <== y", "x  y"),
        (X.plain_punctuation, "“a” ‘b’ c–d e—f g… h", "\"a\" 'b' c-d e-f g... h"),
        (X.collapse_space, "  a \t b  \n\n\n\nc\t\n ", "a b\n\nc"),
        (X.drop_page_artifacts, "Head\nx one\n12\nHead\ny two\n 7 \nHead\n# Head", "x one\ny two\n# Head"),
        (X.drop_page_artifacts, "Head\nHead\nx", "Head\nHead\nx"),
        (lambda c: X.apply_footnotes(c, "skip"), "a\n[^1]: note\nb", "a\nb"),
        (lambda c: X.apply_footnotes(c, "endnote"), "a\n [2] note\nb", "a\nb\n\n---\n\n## Notes\n\n[2] note"),
        (lambda c: X.apply_footnotes(c, "endnote"), "a\nb", "a\nb"),
        (X.demote_code_headings, "# **Bold Title**\n## x = f(1)\n# " + "w" * 71, "# Bold Title\nx = f(1)\n" + "w" * 71),
        (X.slugify, "Ünï  Côde -- Title!", "uni-code-title"),
        (X.slugify, "日本", "untitled"),
        (lambda c: X.slugify(c, 8), "alpha-beta-gamma", "alpha"),
        (X.safe_filename, ' a/b:c*?  "d". ', "abc d"),
        (X.safe_filename, "...", "book"),
        (X.word_count, " a b\tc ", 3),
        (X.word_count, "  ", 0),
        (X.html_text, "<p>a<b>b</b></p><script>x</script> &amp; c", "a b & c"),
        (lambda c: F.array_join(X.html_headings(c), "|"), "<h1>A <i>b</i></h1><H2 x='1'>C &amp;\n D</H2><h1>A b</h1>", "A b|C & D"),
    ],
)
def test_scalar(spark, how, given, want):
    assert one(spark, how, given) == want


@pytest.mark.parametrize("how", [X.unify_line_ends, X.collapse_space, X.drop_page_artifacts, X.demote_code_headings, X.clean_markdown, X.slugify, X.safe_filename, X.word_count, X.html_text])
def test_null_stays_null_and_empty_is_taken(spark, how):
    assert one(spark, how, None) is None
    assert one(spark, how, "") is not None


def test_features(spark):
    r = one(spark, X.html_features, "<PRE>x</PRE><span class='a math b'>y</span>")
    assert (r.has_code, r.has_math, r.has_tables) == (True, True, False)


def test_policy_is_checked():
    with pytest.raises(ValueError, match="policy"):
        X.apply_footnotes(F.lit("x") if False else None, "other")


@pytest.mark.parametrize(
    ("markdown", "html"),
    [
        ("# A *b* #\n\ntwo\nlines", "<h1>A <em>b</em></h1>\n<p>two\nlines</p>"), ("```py\na < b\n```", '<pre><code class="language-py">a &lt; b\n</code></pre>'), ("| a | b |\n|---|:-:|\n| 1 | `x` |\n| 2 |", "<table>\n<thead>\n<tr><th>a</th><th>b</th></tr>\n</thead>\n<tbody>\n<tr><td>1</td><td><code>x</code></td></tr>\n<tr><td>2</td><td></td></tr>\n</tbody>\n</table>"),
        ("- a\n- **b**\n  c", "<ul>\n<li>a</li>\n<li><strong>b</strong> c</li>\n</ul>"), ("1. a\n2. b", "<ol>\n<li>a</li>\n<li>b</li>\n</ol>"), ("> q\n> r", "<blockquote>\n<p>q\nr</p>\n</blockquote>"), ("---", "<hr />"), ("[t](u) & ![i](v)", '<p><a href="u">t</a> &amp; <img alt="i" src="v" /></p>'),
        ("a_b_c 2 * 3 * 4", "<p>a_b_c 2 * 3 * 4</p>"), ("```\nopen", "<pre><code>open\n</code></pre>"), ("", ""), (None, None),
    ],
)
def test_markdown_to_html(markdown, html):
    assert X.markdown_html_of(markdown) == html
