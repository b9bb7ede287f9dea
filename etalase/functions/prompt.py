"""The text that asks for a comparison, and the patterns that read the answer."""

from typing import NamedTuple

# The request wording, the labels of a product block and the answer
# patterns. The assistant's name and the greeting are the caller's.
HEAD = """\
KONSISTEN JIKA DITANYAN BERKALI KALI!, Kamu bernama {assistant}, jangan menggunakan kata Namun, \
Saya ingin Anda membandingkan beberapa produk berdasarkan atribut berikut: \
nama produk, rating, deskripsi, harga, jumlah terjual, kategori, minimal pembelian, \
dimensi ukuran, penjual, dan lokasi pengiriman. Fokuslah pada keunggulan, kekurangan, \
dan kecocokan pengiriman produk tersebut dengan pembeli. \
Ingat Buat dengan bahasa manusia dan singkat saja

Berikut adalah produk-produk yang akan dibandingkan:
"""
BLOCK = [
    ("Nama Produk: ", "product_name"),
    ("Rating: ", "rating"),
    ("Deskripsi: ", "description"),
    ("Harga: Rp", "product_price"),
    ("Jumlah Terjual: ", "jumlah_terjual"),
    ("Kategori: ", "kategori"),
    ("Minimal Pembelian: ", "min_pembelian"),
    ("Dimensi Ukuran: ", "dimensi_ukuran"),
    ("Penjual: ", "penjual"),
]
TAIL = """\
Berikut instruksi untuk hasil analisis YANG KONSISTEN:
- Buat keunggulan dan kekurangan masing-masing produk berdasarkan atribut di atas.
- Berikan kesimpulan produk mana yang lebih baik untuk pembeli tanpa imbuhan apapun.
Fokus pada product ini saja, jangan hal lain, jangan menggunakan kata Namun. \
JANGAN MENGHINA/MENJELEKKAN PRODUCT MANAPUN, BAIK PENJUALNYA ATAUPUN PRODUCTNYA.\
INGAT KALAU ANDA DITANYA 2 HINGGA BERKALI KALI, JAWABAN ANDA HARUS KONSISTEN\
Cara menjawab Berikan {greeting} dan tetap 1 product yang lebih baik. \
Gunakan template berikut untuk menjawab:

{greeting}!

Berikut adalah hasil analisis produk-produk yang dibandingkan:

**Produk A**
* Keunggulan:
a.
b.
c.
* Kekurangan:
a.
b.
c.

**Produk B**
* Keunggulan:
a.
b.
c.
* Kekurangan:
a.
b.
c.

**Produk C**
* Keunggulan:
a.
b.
c.
* Kekurangan:
a.
b.
c.

Saya rekomendasikan <Product Terbaik> Untuk anda beli Karena <Alasan>

Terima Kasih, Jangan Lupa Checkout"""
# (?d): only a line feed ends a line.
RECOMMENDATION = r"(?d)Saya rekomendasikan .* Untuk anda beli Karena .*"
BOLD_NAME = r"(?d)Saya rekomendasikan \*\*(.*?)\*\*"


class Template(NamedTuple):
    head: str
    tail: str


def template(assistant: str = "Asisten", greeting: str = "Hallo") -> Template:
    return Template(HEAD.format(assistant=assistant), TAIL.format(greeting=greeting))
