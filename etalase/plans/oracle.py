"""The same results in SQL.

The rules are written anew here; column lists, labels and the prompt's wording come from the
same constants as in the operators, so a slip in those texts does not show.
"""

from etalase.functions.prompt import BLOCK, template
from etalase.schemas import DETAIL, RAW, SIMILAR, SUMMARY

_PRODUCTS = """
sales AS (
  SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS sold, count(*) AS lines,
         count(*) FILTER (WHERE l_returnflag = 'R') AS returned, min(l_suppkey) AS seller
  FROM lineitem GROUP BY l_partkey),
products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
         p_name AS product_name,
         CAST(floor(p_retailprice) AS BIGINT) AS product_price,
         CAST(p_size AS BIGINT) AS stok,
         coalesce(sold, 0) AS jumlah_terjual,
         floor((5.0::DOUBLE - 4.0::DOUBLE * returned / lines) * 10) / 10 AS rating,
         '/img/' || p_partkey || '.jpg 1x' AS image_srcset,
         p_type AS kategori,
         p_brand AS brand,
         CAST(1 + p_size % 5 AS BIGINT) AS min_pembelian,
         CAST(p_size * 100 AS BIGINT) AS berat_satuan,
         p_size || ' cm x ' || p_size || ' cm' AS dimensi_ukuran,
         'NATION_' || (seller % 25) AS dikirim_dari,
         'Supplier#' || seller AS penjual,
         p_brand || ' ' || p_type || ' ' || p_name || ' ' || p_size AS description
  FROM part LEFT JOIN sales ON p_partkey = l_partkey)"""

_FEATURES = """
features AS (
  SELECT CAST(vec_id AS VARCHAR) AS product_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""

_MANY = """
many AS (SELECT * FROM features
  UNION ALL SELECT '7', CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id % 25 = 0)"""

_LISTS = """
listed AS (SELECT * FROM products
  UNION ALL SELECT * FROM products WHERE CAST(product_id AS BIGINT) % 50 = 0),
known AS (SELECT product_id, count(*) AS n FROM listed GROUP BY product_id),
asked AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS request_id, 1 + o_orderkey % 199 AS k, o_orderkey % 9 AS kind FROM orders),
lists AS (
  SELECT request_id, CASE kind WHEN 0 THEN [] WHEN 1 THEN [] WHEN 2 THEN [k, k] WHEN 3 THEN [50, -1] WHEN 4 THEN [k]
    WHEN 5 THEN [k, k + 1, k + 2, k + 3, k + 4] WHEN 6 THEN [k, NULL] WHEN 7 THEN [k, k + 1]
    ELSE [k + 2, k + 1, k] END AS ids
  FROM asked),
wanted AS (SELECT request_id, CAST(unnest(ids) AS VARCHAR) AS product_id FROM lists),
looked AS (
  SELECT request_id, count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE n > 1) AS twice
  FROM wanted LEFT JOIN known USING (product_id) GROUP BY request_id),
judged AS (
  SELECT request_id, CASE WHEN len(ids) NOT BETWEEN 2 AND 3 THEN 'size'
    WHEN len(ids) = 2 AND ids[1] = ids[2] THEN 'duplicate_id'
    WHEN missing > 0 THEN 'unknown_id' WHEN twice > 0 THEN 'repeated_product' END AS reason
  FROM lists LEFT JOIN looked USING (request_id))"""

_ROUGH_REQUESTS = """
asked AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey = 1 THEN 0 ELSE c_custkey % 6 END AS kind FROM customer)"""

_PAGE_REQUESTS = """
asked AS (
  SELECT CAST(c_custkey AS VARCHAR) AS request_id,
         CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey ELSE 10 END AS lim,
         CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 50 ELSE 1 END AS page
  FROM customer)"""

_COSINE = "CAST(list_cosine_similarity({0}, {1}) AS FLOAT)"

_REQUESTS = """
items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS request_id, CAST(l_partkey + 5 AS VARCHAR) AS product_id,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, CAST(l_partkey + 5 AS VARCHAR)) AS place
  FROM lineitem),
judged AS (
  SELECT request_id,
         CASE WHEN count(*) NOT BETWEEN 2 AND 3 THEN 'size'
              WHEN count(DISTINCT i.product_id) < count(*) THEN 'duplicate_id'
              WHEN count(p.product_id) < count(*) THEN 'unknown_id' END AS reason
  FROM items i LEFT JOIN products p ON p.product_id = i.product_id GROUP BY request_id),
compared AS (
  SELECT request_id, place, p.* FROM items JOIN products p USING (product_id)
  WHERE request_id IN (SELECT request_id FROM judged WHERE reason IS NULL))"""

_ANSWERS = r"""
sized AS (
  SELECT *, count(*) OVER (PARTITION BY request_id) AS n, CAST(request_id AS BIGINT) AS k FROM compared),
answers AS (
  SELECT request_id, 'Hallo!' || chr(10) || chr(10) || CASE k % 5
      WHEN 0 THEN 'Saya rekomendasikan **' || product_name || '** Untuk anda beli Karena murah.'
      WHEN 1 THEN 'Saya rekomendasikan produk ' || upper(product_name) || ' Untuk anda beli Karena bagus'
      WHEN 2 THEN 'Tidak ada pilihan.'
      WHEN 3 THEN 'Saya rekomendasikan **Produk lain** Untuk anda beli Karena ' || product_name
      ELSE 'Saya rekomendasikan **' || product_name || '** saja' END
    || chr(10) || chr(10) || 'Terima Kasih' AS answer
  FROM sized WHERE place = k % n + 1),
read AS (
  SELECT c.request_id, place, product_id, product_name, answer,
         lower(regexp_extract(answer, 'Saya rekomendasikan [^\n]* Untuk anda beli Karena [^\n]*')) AS line,
         regexp_extract(answer, 'Saya rekomendasikan \*\*([^\n]*?)\*\*', 1) AS bold
  FROM compared c JOIN answers USING (request_id)),
scored AS (
  SELECT *, len(list_filter(list_distinct(string_split(lower(product_name), ' ')),
                            lambda w: contains(line, w))) AS hits FROM read),
best AS (
  SELECT request_id, arg_max(product_name, hits * 10 - place) AS name
  FROM scored WHERE hits > 0 GROUP BY request_id)"""

_RAW = """
raw AS (
  SELECT '  Part ' || l_partkey || ' ' AS "Product_Name",
         'Rp' || replace(format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)), ',', '.') AS "Product_Price",
         'Stok ' || l_linenumber AS "Stok",
         CASE WHEN l_returnflag = 'N' THEN 'Terjual ' || CAST(l_quantity AS BIGINT)
              ELSE 'Belum terjual' END AS "Jumlah_Terjual",
         CASE WHEN l_linestatus = 'O' THEN '4,' || l_linenumber END AS "Rating",
         '/img/' || l_partkey || '.jpg 1x' AS "Image_Srcset",
         l_returnflag AS "Kategori",
         l_linestatus AS "Brand",
         '1 pcs' AS "Min_Pembelian",
         CAST(l_quantity AS BIGINT) || '00 gram' AS "Berat_Satuan",
         l_linenumber || ' cm x ' || l_linenumber || ' cm' AS "Dimensi_Ukuran",
         'NATION_' || (l_suppkey % 25) AS "Dikirim_Dari",
         'Supplier#' || l_suppkey AS "Penjual",
         'Order ' || l_orderkey AS "Description",
         '/product/' || l_partkey AS "URL",
         l_shipdate AS "Update"
  FROM lineitem)"""

_CLEAN = """
  SELECT md5("URL") AS product_id, trim("Product_Name") AS product_name,
         "Image_Srcset" AS image_srcset, "Kategori" AS kategori, "Brand" AS brand,
         "Dimensi_Ukuran" AS dimensi_ukuran, "Dikirim_Dari" AS dikirim_dari, "Penjual" AS penjual,
         "Description" AS description,
         CAST(replace(substr("Product_Price", 3), '.', '') AS BIGINT) AS product_price,
         CAST(substr("Stok", 6) AS BIGINT) AS stok,
         CAST(nullif(regexp_extract("Jumlah_Terjual", '[0-9]+'), '') AS BIGINT) AS jumlah_terjual,
         CAST(1 AS BIGINT) AS min_pembelian,
         CAST(replace("Berat_Satuan", ' gram', '') AS BIGINT) AS berat_satuan,
         CAST(replace("Rating", ',', '.') AS DOUBLE) AS rating,
         CASE WHEN "Jumlah_Terjual" = 'Belum terjual' THEN 'jumlah_terjual' ELSE '' END AS problems
  FROM """


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _tagged(tag: str) -> str:
    """Text of the only such tag on a page, with the character references it may hold.

    These references are also read where their semicolon is missing.
    """
    sql = f"regexp_extract(html, '<{tag}>(.*?)</{tag}>', 1)"
    for written, meant in [("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&#x27", "'"), ("&amp", "&")]:
        sql = f"regexp_replace({sql}, '{written};?', {_text(meant)}, 'g')"
    return f"trim({sql})"


_FIELDS = f"""SELECT page_id, url, {_tagged("h1")} AS heading, {_tagged("title")} AS title,
    CAST(NULL AS VARCHAR) AS error FROM pages"""
_prompt = template()
_block = " || ".join(
    f"{_text(label)} || coalesce(CAST({column} AS VARCHAR), 'None') || chr(10)"
    for label, column in BLOCK
)
_raw_order = ", ".join(
    ['"Update" DESC NULLS LAST']
    + [f'"{f.name}" DESC NULLS LAST' for f in RAW.fields if f.name not in ("URL", "Update")]
)
_detail = ", ".join(DETAIL)
_summary = ", ".join(SUMMARY)
_similar = ", ".join(SIMILAR[:-1])

ORACLE: dict[str, str] = {
    "catalog_all": f"WITH {_PRODUCTS} SELECT {_summary} FROM products ORDER BY product_id",
    "catalog_detail": f"WITH {_PRODUCTS} SELECT {_detail} FROM products ORDER BY product_id",
    "product_by_id": f"WITH {_PRODUCTS} SELECT {_detail} FROM products WHERE product_id = '7'",
    "products_by_ids": f"""WITH {_PRODUCTS} SELECT {_detail} FROM products
        WHERE product_id IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings)""",
    "fetch_by_ids": f"""WITH {_PRODUCTS} SELECT {_detail} FROM products
        WHERE product_id IN ('7', '42', 'no such id')""",
    "catalog_page": f"""WITH {_PRODUCTS} SELECT {_summary} FROM products
        ORDER BY product_id LIMIT 10 OFFSET 20""",
    "catalog_page_after": f"""WITH {_PRODUCTS} SELECT {_summary} FROM products
        WHERE product_id > '150' ORDER BY product_id LIMIT 10""",
    "catalog_page_index": f"""WITH {_PRODUCTS},
        placed AS (SELECT *, row_number() OVER (ORDER BY product_id) - 1 AS position FROM products)
        SELECT position // 10 + 1 AS page, position, {_summary} FROM placed""",
    "catalog_pages_requested": f"""WITH {_PRODUCTS}, {_PAGE_REQUESTS},
        placed AS (SELECT *, row_number() OVER (ORDER BY product_id) - 1 AS position FROM products)
        SELECT request_id, position, {_summary} FROM asked JOIN placed
          ON position >= (page - 1) * lim AND position < page * lim WHERE page >= 1""",
    "catalog_pages_refused": f"""WITH {_PAGE_REQUESTS}
        SELECT request_id, 'out_of_range' AS reason FROM asked WHERE page < 1""",
    "catalog_pages_rough": f"""WITH {_PRODUCTS}, {_ROUGH_REQUESTS},
        placed AS (SELECT *, row_number() OVER (ORDER BY product_id) - 1 AS position FROM products)
        SELECT CAST(k AS VARCHAR) AS request_id, position, {_summary} FROM asked JOIN placed
          ON k = 1 OR (kind = 5 AND position BETWEEN 3 AND 5)""",
    "catalog_pages_rough_refused": f"""WITH {_ROUGH_REQUESTS}
        SELECT CAST(k AS VARCHAR) AS request_id,
               CASE kind WHEN 1 THEN 'not_a_number' ELSE 'out_of_range' END AS reason
        FROM asked WHERE k <> 1 AND kind IN (0, 1, 2)""",
    "search_name": f"""WITH {_PRODUCTS} SELECT {_summary} FROM products
        WHERE contains(lower(product_name), 'ring') ORDER BY product_id""",
    "search_terms": f"""WITH {_PRODUCTS},
        terms AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part)
        SELECT term, {_summary} FROM products JOIN terms
          ON contains(lower(product_name), lower(term)) WHERE term <> ''""",
    "similar_products": f"""WITH {_PRODUCTS}, {_FEATURES},
        scored AS (
          SELECT b.product_id, {_COSINE.format("a.v", "b.v")} AS c FROM features a, features b
          WHERE a.product_id = '7' AND b.product_id <> '7')
        SELECT {_similar}, round(CAST(c AS DOUBLE), 6) AS cosine_similarity
        FROM scored JOIN products USING (product_id)
        ORDER BY c DESC, rating DESC NULLS LAST, jumlah_terjual DESC NULLS LAST, product_id
        LIMIT 10""",
    "similar_topk_first": f"""WITH {_PRODUCTS}, {_FEATURES},
        top AS (
          SELECT b.product_id, {_COSINE.format("a.v", "b.v")} AS c FROM features a, features b
          WHERE a.product_id = '7' AND b.product_id <> '7'
          ORDER BY c DESC, b.product_id LIMIT 10)
        SELECT product_id, product_price, product_name, round(CAST(c AS DOUBLE), 6) AS cosine_similarity
        FROM top JOIN products USING (product_id)""",
    "similar_all": f"""WITH {_PRODUCTS}, {_FEATURES},
        scored AS (
          SELECT a.product_id AS query_id, b.product_id, rating, jumlah_terjual,
                 {_COSINE.format("a.v", "b.v")} AS c
          FROM features a JOIN features b ON a.product_id <> b.product_id
          JOIN products p ON p.product_id = b.product_id),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC,
                 rating DESC NULLS LAST, jumlah_terjual DESC NULLS LAST, product_id) AS rank
          FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, product_id, round(CAST(c AS DOUBLE), 6) AS cosine_similarity
        FROM ranked WHERE rank <= 10""",
    "similar_many_vectors": f"""WITH {_PRODUCTS}, {_FEATURES}, {_MANY},
        scored AS (
          SELECT b.product_id, {_COSINE.format("a.v", "b.v")} AS c FROM many a, many b
          WHERE a.product_id = '7' AND b.product_id <> '7')
        SELECT {_similar}, round(CAST(c AS DOUBLE), 6) AS cosine_similarity
        FROM scored JOIN products USING (product_id)
        ORDER BY c DESC, rating DESC NULLS LAST, jumlah_terjual DESC NULLS LAST, product_id
        LIMIT 10""",
    "catalog_json": f"""WITH {_PRODUCTS}
        SELECT CAST(to_json(s) AS VARCHAR) AS record FROM (SELECT {_summary} FROM products) s""",
    "compare_requests_valid": f"""WITH {_PRODUCTS}, {_REQUESTS}
        SELECT request_id, reason IS NULL AS valid, reason FROM judged""",
    "compare_requests_all": f"""WITH {_PRODUCTS}, {_LISTS}
        SELECT request_id, reason IS NULL AS valid, reason,
               CASE WHEN reason IS NULL THEN CAST(1 AS INTEGER) END AS messages FROM judged""",
    "compare_prompts": f"""WITH {_PRODUCTS}, {_REQUESTS}
        SELECT request_id, 'user' AS role, {_text(_prompt.head)}
            || string_agg({_block} || chr(10), '' ORDER BY place) || {_text(_prompt.tail)} AS content
        FROM compared GROUP BY request_id""",
    "compare_answers": f"""WITH {_PRODUCTS}, {_REQUESTS}, {_ANSWERS}
        SELECT s.request_id, any_value(answer) AS comparison_result,
               coalesce(arg_min(product_id, place) FILTER (WHERE bold <> '' AND product_name = bold),
                        arg_max(product_id, place) FILTER (WHERE product_name = name)) AS best_product_id
        FROM scored s LEFT JOIN best USING (request_id) GROUP BY s.request_id""",
    "listing_frontier": """
        SELECT category, CAST(page AS INTEGER) AS page,
               'https://shop.example/c/' || category || '?page=' || page AS url
        FROM (SELECT DISTINCT lower(p_type || '-' || replace(p_brand, '#', '-')) AS category FROM part)
        CROSS JOIN range(1, 201) t(page)""",
    "page_links": """
        SELECT page_url, CAST(place - 1 AS INTEGER) AS place, href, 'https://shop.example' || href AS url
        FROM (SELECT url AS page_url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS place
              FROM (SELECT url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages))
        WHERE contains(href, '/th')""",
    "page_fields": _FIELDS,
    "stream_append": _FIELDS,
    "spec_rows": f"""WITH {_PRODUCTS}
        SELECT product_name AS "Product_Name", 'Rp' || product_price AS "Product_Price",
               CAST(stok AS VARCHAR) AS "Stok", 'Terjual ' || jumlah_terjual AS "Jumlah_Terjual",
               CAST(rating AS VARCHAR) AS "Rating", image_srcset AS "Image_Srcset",
               kategori AS "Kategori", brand AS "Brand", CAST(min_pembelian AS VARCHAR) AS "Min_Pembelian",
               CAST(berat_satuan AS VARCHAR) AS "Berat_Satuan", dimensi_ukuran AS "Dimensi_Ukuran",
               dikirim_dari AS "Dikirim_Dari", penjual AS "Penjual",
               description || '& lainnya' AS "Description", '/product/' || product_id AS "URL"
        FROM products""",
    "ingest_faults": f"""WITH {_PRODUCTS},
        pages_read AS (SELECT '/product/' || product_id AS "URL", CAST(product_id AS BIGINT) % 10 AS kind FROM products),
        rows_read AS (
          SELECT CASE WHEN kind IN (3, 4) THEN 'faulty' ELSE 'stored' END AS kind, "URL",
                 CASE kind WHEN 3 THEN 'no page' WHEN 4 THEN 'LookupError: no span below a' END AS error
          FROM pages_read)
        SELECT *, true AS stamped FROM rows_read
        UNION ALL SELECT 'count of ' || kind, NULL, CAST(count(*) AS VARCHAR), NULL FROM rows_read GROUP BY kind""",
    "append_roundtrip": f"WITH {_RAW} SELECT * FROM raw",
    "clean_products": f"WITH {_RAW} {_CLEAN} raw",
    "latest_products": f"""WITH {_RAW},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY "URL" ORDER BY {_raw_order}) AS n FROM raw)
        {_CLEAN} ranked WHERE n = 1""",
    "clean_rough": f"""WITH {_RAW},
        numbered AS (SELECT *, CAST(substr("Description", 7) AS BIGINT) AS o FROM raw),
        rough AS (
          SELECT * REPLACE (
              ['1,2 rb terjual', '10rb+', 'Terjual 1.234', 'Terjual 12.34', '3 terjual', ''][o % 6 + 1] AS "Jumlah_Terjual",
              ['2.5 kg', '2 kg', '1.500 gram', '500 gram', '10 x 20 gram', '-5 gram'][o % 6 + 1] AS "Berat_Satuan",
              ['4,5', '4.5/5', '5', '4,5,6', 'belum ada', 'Rating 3.9 bintang'][o % 6 + 1] AS "Rating",
              CASE WHEN o % 7 <> 0 THEN "URL" END AS "URL")
          FROM numbered),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY "URL" ORDER BY {_raw_order}) AS n FROM rough)
        SELECT md5("URL") AS product_id, trim("Product_Name") AS product_name,
               "Image_Srcset" AS image_srcset, "Kategori" AS kategori, "Brand" AS brand,
               "Dimensi_Ukuran" AS dimensi_ukuran, "Dikirim_Dari" AS dikirim_dari, "Penjual" AS penjual,
               "Description" AS description,
               CAST(replace(substr("Product_Price", 3), '.', '') AS BIGINT) AS product_price,
               CAST(substr("Stok", 6) AS BIGINT) AS stok,
               CAST([NULL, NULL, 1234, NULL, 3, NULL][o % 6 + 1] AS BIGINT) AS jumlah_terjual,
               CAST(1 AS BIGINT) AS min_pembelian,
               CAST([NULL, NULL, 1500, 500, NULL, NULL][o % 6 + 1] AS BIGINT) AS berat_satuan,
               CAST([4.5, 4.5, 5, NULL, NULL, 3.9][o % 6 + 1] AS DOUBLE) AS rating,
               array_to_string(list_filter([
                 CASE WHEN o % 6 IN (0, 1, 3) THEN 'jumlah_terjual' END,
                 CASE WHEN o % 6 IN (0, 1, 4, 5) THEN 'berat_satuan' END,
                 CASE WHEN o % 6 IN (3, 4) THEN 'rating' END,
                 CASE WHEN "URL" IS NULL THEN 'product_id' END], lambda x: x IS NOT NULL), ',') AS problems
        FROM ranked WHERE n = 1 OR "URL" IS NULL""",
    "text_features": r"""
        WITH places AS (
          SELECT CAST(doc_id AS VARCHAR) AS product_id,
                 CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS INTEGER) AS place
          FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents)),
        counts AS (SELECT product_id, place, count(*) AS n FROM places GROUP BY ALL),
        rarity AS (
          SELECT place, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS rarity
          FROM counts GROUP BY place)
        SELECT product_id, place, round(n * rarity, 6) AS weight
        FROM counts JOIN rarity USING (place) WHERE n * rarity <> 0""",
}

ORACLE["similar_all_cells"] = ORACLE["similar_all"]
