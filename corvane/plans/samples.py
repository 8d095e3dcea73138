"""Small sources and paths for the code queries."""

PATHS = [
    "/app/user.go", "/app/user_test.go", "/app/types.go", "/app/user_store.go", "/lib/parser.py", "/lib/test_parser.py", "/lib/parse_tools.py",
    "/web/form.ts", "/web/form.spec.ts", "/web/tests/form_case.ts", "/doc/readme.md", "/doc/readable.md", "/etc/run.sh", "/etc/x.unknown", "/etc/Makefile", "/a.b/c",
]

EDGES = [("main", "parse", 3), ("main", "read", 4), ("main", "fmt.Println", 5), ("parse", "read", 12), ("parse", "parse", 14), ("read", "os.Open", 20), ("main", "parse", 7)]

GO_SOURCE = '''// Package sample holds one of each kind of declaration.
package sample

import (
	"fmt"
	str "strings"

	"example.org/shop/cart"
)

// Limit bounds a basket.
const Limit = 10

var (
	first, second = 1, 2
	names         []string
)

// Item is one line of an order.
type Item struct {
	Name  string `json:"name"`
	Price int
	cart.Entry
}

// Store keeps items.
type Store interface {
	Put(item Item) error
	All() ([]Item, error)
	fmt.Stringer
}

type Handler func(string) error

// Add puts an item into the basket.
func (b *Basket) Add(item Item, n int) (total int, err error) {
	if n > Limit {
		return 0, fmt.Errorf("too many: %d", n)
	}
	b.items = append(b.items, item)
	return b.Total(), nil
}

func (b *Basket) Total() int {
	sum := 0
	for _, i := range b.items {
		sum += price(i)
	}
	go func() { log("total") }()
	return sum
}

func price(i Item) int { return i.Price * first }

func log(text string) {
	fmt.Println(str.ToUpper(text))
}
'''

SOURCES = {
    "/app/sample.go": GO_SOURCE,
    "/lib/parser.py": '''import re
# A parser
# of small things
# TODO: speed

class Parser(Base):
    """Reads
    text."""

    def read(self, text):
        return re.findall("x", text)

class Plain:
    def __init__(self):
        pass
''',
    "/web/form.ts": '''import { a } from "shop/cart/view"
/* one line */
/*
 many lines
*/
class Form extends Base {
}
const size = 3
let count=0
function draw(x) { return x }
// FIXME later
// plain
''',
    "/src/App.java": '''public class App<T> {
    private class Inner {
    }
}
interface Shape {
}
public interface Round extends Shape { }
''',
    "/bin/run.sh": '''#!/bin/sh
# start
# the server
echo hi # not a comment line
''',
}
